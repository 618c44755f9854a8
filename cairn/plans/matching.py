"""Queries on features: similarity joins, tracks, landmarks, voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.operators import simjoin, tracks, voxels
from cairn.plans.bindings import FEATURES_SQL, features
from cairn.plans.registry import query
from cairn.session import checkpoint

#: Similar enough to match: vectors of the test tables are nearly orthogonal.
MIN_COSINE = 0.25
RATIO = 0.95

_COSINE_SQL = f"""
WITH {FEATURES_SQL}, s AS (
    SELECT a.row_id AS first, b.row_id AS second, a.feature_id AS left_id, b.feature_id AS right_id,
           list_cosine_similarity(a.descriptor, b.descriptor) AS score, list_distance(a.descriptor, b.descriptor) AS distance
    FROM features AS a JOIN features AS b ON a.row_id < b.row_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY first, second, left_id ORDER BY score DESC) AS l, row_number() OVER (PARTITION BY first, second, right_id ORDER BY score DESC) AS r FROM s
), edges AS (SELECT first, second, left_id, right_id, score, distance FROM r WHERE l = 1 AND r = 1 AND score >= {MIN_COSINE})
"""


def cosine_edges(spark: SparkSession, sf_dir: str, least: float = MIN_COSINE) -> DataFrame:
    return simjoin.match_frames(features(spark, sf_dir), simjoin.mutual_cosine(least))


@query(_COSINE_SQL + "SELECT first, second, count(*) AS matches, round(avg(score), 6) AS mean_score FROM edges GROUP BY first, second")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique mutual-best cosine matches of every pair of frames."""
    totals = simjoin.match_totals(features(spark, sf_dir), simjoin.mutual_cosine(MIN_COSINE))
    return totals.select("first", "second", "matches", F.round(F.col("score") / F.col("matches"), 6).alias("mean_score"))


@query(_COSINE_SQL + "SELECT first, second, left_id, right_id, round(score, 6) AS score, round(distance, 6) AS distance FROM edges")
def match_edges_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_edges(spark, sf_dir).withColumns({"score": F.round("score", 6), "distance": F.round("distance", 6)})


@query(
    f"""WITH {FEATURES_SQL}, s AS (
    SELECT a.row_id AS first, b.row_id AS second, a.feature_id AS left_id, b.feature_id AS right_id, list_distance(a.descriptor, b.descriptor) AS d
    FROM features AS a JOIN features AS b ON a.row_id < b.row_id
), r AS (
    SELECT *, row_number() OVER l AS l, row_number() OVER r AS r, nth_value(d, 2) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ld, nth_value(d, 2) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rd FROM s
    WINDOW l AS (PARTITION BY first, second, left_id ORDER BY d), r AS (PARTITION BY first, second, right_id ORDER BY d)
) SELECT first, second, left_id, right_id, round(1 - sqrt(greatest(d * d / (ld * ld), d * d / (rd * rd))), 6) AS score, round(d, 6) AS distance FROM r
WHERE l = 1 AND r = 1 AND d < {RATIO} * ld AND d < {RATIO} * rd"""
)
def match_edges_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = simjoin.match_frames(features(spark, sf_dir), simjoin.mutual_ratio(RATIO))
    return edges.withColumns({"score": F.round("score", 6), "distance": F.round("distance", 6)})


@query(f"WITH {FEATURES_SQL}, f AS (SELECT DISTINCT row_id FROM features) SELECT a.row_id AS first, b.row_id AS second, b.row_id - a.row_id AS gap FROM f AS a JOIN f AS b ON a.row_id < b.row_id")
def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.frame_pairs(features(spark, sf_dir))


@query(
    f"""WITH {FEATURES_SQL}, f AS (SELECT DISTINCT row_id FROM features)
SELECT a.row_id AS first, b.row_id AS second FROM f AS a JOIN f AS b ON a.row_id < b.row_id WHERE (a.row_id + b.row_id) % 3 <> 0 AND a.row_id % 2 = 0 AND b.row_id % 2 = 0"""
)
def pending_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of selected frames that are not done yet: two semi joins and an anti join."""
    pairs = simjoin.frame_pairs(features(spark, sf_dir)).drop("gap")
    done = pairs.where(F.pmod(F.col("first") + F.col("second"), F.lit(3)) == 0)
    chosen = features(spark, sf_dir).select("row_id").distinct().where(F.pmod("row_id", F.lit(2)) == 0)
    kept = pairs.join(chosen.withColumnRenamed("row_id", "first"), "first", "left_semi").join(chosen.withColumnRenamed("row_id", "second"), "second", "left_semi")
    return kept.join(done, ["first", "second"], "left_anti").select("first", "second")


@query(
    _COSINE_SQL
    + f""", n AS (SELECT first, second, count(*) AS matches FROM edges GROUP BY first, second), f AS (SELECT DISTINCT vec_id // 25 AS row_id FROM embeddings)
SELECT a.row_id AS first, b.row_id AS second, CASE WHEN a.row_id = b.row_id THEN -2 ELSE coalesce(n.matches, 0) END AS matches,
       round(CASE WHEN a.row_id = b.row_id THEN 0 ELSE ln(1 + coalesce(n.matches, 0)) / ln(1 + (SELECT max(matches) FROM n)) END, 6) AS heat
FROM f AS a CROSS JOIN f AS b LEFT JOIN n ON n.first = least(a.row_id, b.row_id) AND n.second = greatest(a.row_id, b.row_id)"""
)
def match_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetric count matrix: pairs without matches are 0, the diagonal is -2."""
    counts = checkpoint(match_counts(spark, sf_dir).select("first", "second", "matches"))
    both = simjoin.frame_pairs(features(spark, sf_dir)).drop("gap").join(counts, ["first", "second"], "left").fillna(0, ["matches"])
    mirrored = both.union(both.select("second", "first", "matches"))
    most = F.broadcast(counts.agg(F.max("matches").alias("most")))
    heated = mirrored.join(most, F.lit(True)).select("first", "second", "matches", F.round(F.log1p("matches") / F.log1p("most"), 6).alias("heat"))
    diagonal = features(spark, sf_dir).select("row_id").distinct().select("row_id", F.col("row_id").alias("second"), F.lit(-2).cast("long").alias("matches"), F.lit(0.0).alias("heat"))
    return heated.union(diagonal)


def _nodes_and_edges(spark: SparkSession, sf_dir: str, least: float = MIN_COSINE) -> tuple[DataFrame, DataFrame]:
    nodes = features(spark, sf_dir).select((F.col("row_id") * 25 + F.col("feature_id")).alias("node"), F.col("row_id").alias("frame"))
    edges = cosine_edges(spark, sf_dir, least).select((F.col("first") * 25 + F.col("left_id")).alias("left"), (F.col("second") * 25 + F.col("right_id")).alias("right"), "score")
    return nodes, edges


@query()
def track_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-unique tracks: the greedy, score-ordered merge, component by component."""
    return tracks.associate_tracks(*_nodes_and_edges(spark, sf_dir))


@query()
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.track_summary(track_members(spark, sf_dir))


@query(
    _COSINE_SQL.replace("WITH", "WITH RECURSIVE", 1).replace(f"score >= {MIN_COSINE}", "score >= 0.4")
    + """, e AS (SELECT first * 25 + left_id AS a, second * 25 + right_id AS b FROM edges UNION ALL SELECT second * 25 + right_id, first * 25 + left_id FROM edges),
reach(node, other) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT component, count(*) AS nodes FROM (SELECT node, min(other) AS component FROM reach GROUP BY node) GROUP BY component"""
)
def match_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the connected components of the strong matches."""
    from cairn.operators.components import connected_components

    _, edges = _nodes_and_edges(spark, sf_dir, 0.4)
    return connected_components(edges, "left", "right").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    f"""WITH {FEATURES_SQL}, n AS (SELECT label, list_inner_product(descriptor, descriptor) AS sq, descriptor FROM features), u AS (
    SELECT label, unnest(descriptor) / sqrt(sq) AS v, unnest(range(len(descriptor))) AS pos FROM n WHERE sq > 0
), p AS (SELECT label, pos, sum(v) AS s FROM u GROUP BY label, pos)
SELECT p.label, any_value(c.n) AS members, round(sqrt(sum(s * s)) / any_value(c.n), 6) AS concentration FROM p JOIN (SELECT label, count(*) AS n FROM n WHERE sq > 0 GROUP BY label) AS c USING (label) GROUP BY p.label"""
)
def landmark_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical mean by label: the length of the mean unit vector."""
    units = features(spark, sf_dir).where(V.norm(F.col("descriptor")) > 0).select("label", V.normalized(F.col("descriptor")).alias("u"))
    counts = units.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    sums = units.select("label", F.posexplode("u")).groupBy("label", "pos").agg(F.sum("col").alias("s"))
    return sums.groupBy("label").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("r")).join(counts, "label").select("label", "members", F.round(F.col("r") / F.col("members"), 6).alias("concentration"))


_BEST_TWO_SQL = f"""WITH {FEATURES_SQL}, m AS (
    SELECT label, list(s ORDER BY pos) AS mean FROM (SELECT label, pos, sum(v) AS s FROM (SELECT label, unnest(descriptor) AS v, unnest(range(len(descriptor))) AS pos FROM features) GROUP BY label, pos) GROUP BY label
), s AS (SELECT row_id, feature_id, m.label, round(list_cosine_similarity(descriptor, mean), 9) AS c FROM features, m),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id, feature_id ORDER BY c DESC, label) AS n FROM s)
SELECT row_id, feature_id, round(max(CASE WHEN n = 1 THEN c END), 6) AS best, CAST(max(CASE WHEN n = 1 THEN label END) AS INTEGER) AS best_label, round(max(CASE WHEN n = 2 THEN c END), 6) AS second,
       max(CASE WHEN n = 1 THEN c END) >= 0.3 AND max(CASE WHEN n = 1 THEN c END) - max(CASE WHEN n = 2 THEN c END) >= 0.05 AS accepted
FROM r WHERE n <= 2 GROUP BY row_id, feature_id"""


@query(_BEST_TWO_SQL)
def landmark_best_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's best and second landmark by mean direction, with the similarity and margin test."""
    f = features(spark, sf_dir)
    means = f.select("label", F.posexplode("descriptor")).groupBy("label", "pos").agg(F.sum("col").alias("s"))
    means = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("mean"))
    index = F.broadcast(means.agg(F.collect_list(F.struct("label", "mean")).alias("index")))  # ten labels, 64 numbers each
    scored = f.join(index, F.lit(True)).select("row_id", "feature_id", "descriptor", F.explode("index").alias("m")).select("row_id", "feature_id", "m.label", F.round(V.cosine(F.col("descriptor"), F.col("m.mean")), 9).alias("c"))
    best = simjoin.best_two(scored, ["row_id", "feature_id"], "c", "label")
    return best.select("row_id", "feature_id", F.round("best", 6).alias("best"), F.col("best_id").alias("best_label"), F.round("second", 6).alias("second"), simjoin.accepted(F.col("best"), F.col("second"), 0.3, 0.05).alias("accepted"))


_RADIUS = 6.0
_RADIUS_SQL = f"""WITH {FEATURES_SQL}, n AS (
    SELECT a.row_id, a.feature_id AS a_id, b.feature_id AS b_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, list_cosine_similarity(a.descriptor, b.descriptor) AS c
    FROM features AS a JOIN features AS b ON b.row_id = a.row_id + 1 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_RADIUS * _RADIUS}
)"""


def _predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = features(spark, sf_dir)
    return f.select("row_id", F.col("feature_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("descriptor").alias("ad")), f.select((F.col("row_id") - 1).alias("row_id"), F.col("feature_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("descriptor").alias("bd"))


RADIUS_CANDIDATES_SQL = (
    _RADIUS_SQL
    + f"""SELECT row_id, a_id, b_id, round(d2, 6) AS d2, round(cost, 6) AS cost, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id, a_id ORDER BY cost, b_id) AS rank FROM (SELECT *, d2 / {_RADIUS * _RADIUS} + 0.5 * (1 - c) AS cost FROM n WHERE c >= -0.1)) WHERE rank <= 8"""
)


@query(RADIUS_CANDIDATES_SQL)
def radius_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of the next frame near each feature and like it, the eight cheapest."""
    a, b = _predicted(spark, sf_dir)
    similar = V.cosine(F.col("ad"), F.col("bd"))
    cost = F.when(similar >= -0.1, F.col("d2") / (_RADIUS * _RADIUS) + 0.5 * (1 - similar))
    near = simjoin.radius_join(a, b, _RADIUS, ["row_id"], cost=F.coalesce(cost, F.lit(1e9)))
    return near.where("cost < 1e9").select("row_id", "a_id", "b_id", F.round("d2", 6).alias("d2"), F.round("cost", 6).alias("cost"), "rank")


@query(
    _RADIUS_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY row_id, a_id ORDER BY c DESC, b_id) AS l, row_number() OVER (PARTITION BY row_id, b_id ORDER BY c DESC, a_id) AS r FROM n)
SELECT row_id, a_id, b_id, round(c, 6) AS similarity FROM r WHERE l = 1 AND r = 1"""
)
def radius_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual best by cosine among the detections within the radius."""
    a, b = _predicted(spark, sf_dir)
    near = simjoin.radius_join(a, b, _RADIUS, ["row_id"], keep=1 << 30).withColumn("similarity", V.cosine(F.col("ad"), F.col("bd")))
    return simjoin.mutual_best(near, ["row_id"], "a_id", "b_id", "similarity").select("row_id", "a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {FEATURES_SQL}, k AS (SELECT row_id, list(s ORDER BY pos) AS g FROM (
    SELECT row_id, pos, sum(v) AS s FROM (SELECT row_id, unnest(descriptor) AS v, unnest(range(len(descriptor))) AS pos FROM features) GROUP BY row_id, pos) GROUP BY row_id),
p AS (SELECT a.row_id AS row_id, b.row_id AS candidate, round(list_cosine_similarity(a.g, b.g), 9) AS c FROM k AS a JOIN k AS b ON b.row_id <= a.row_id - 3),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY c DESC, candidate) AS rank FROM p)
SELECT row_id, candidate, round(c, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def loop_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five earlier frames, three or more apart, most like each frame by its mean descriptor."""
    sums = features(spark, sf_dir).select("row_id", F.posexplode("descriptor")).groupBy("row_id", "pos").agg(F.sum("col").alias("s"))
    frames = sums.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("g"))
    return simjoin.most_similar(frames, 5, 3).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {FEATURES_SQL} SELECT row_id, count(*) AS features, count(DISTINCT CAST(least(greatest(floor((x + 50) / 25), 0), 3) AS INT) * 4 + CAST(least(greatest(floor((y + 50) / 25), 0), 3) AS INT)) / 16.0 AS coverage FROM features GROUP BY row_id""")
def grid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a 4 by 4 grid that each frame's features occupy."""
    cell = lambda c: F.least(F.greatest(F.floor((F.col(c) + 50) / 25), F.lit(0)), F.lit(3))
    return features(spark, sf_dir).groupBy("row_id").agg(F.count(F.lit(1)).alias("features"), (F.countDistinct(cell("x") * 4 + cell("y")) / 16.0).alias("coverage"))


@query(
    f"""WITH {FEATURES_SQL} SELECT label AS segment, CAST(floor(descriptor[1] / 0.1) AS BIGINT) AS ix, CAST(floor(descriptor[2] / 0.1) AS BIGINT) AS iy, CAST(floor(descriptor[3] / 0.1) AS BIGINT) AS iz,
    count(*) AS samples, round(sum(score), 6) AS weight, round(sum(score * descriptor[4]) / sum(score), 6) AS distance FROM features WHERE score > 0 GROUP BY ALL"""
)
def voxel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean distance of the samples in each voxel of each segment."""
    rows = features(spark, sf_dir).where("score > 0").select("label", "score", *(F.col("descriptor")[i].alias(n) for i, n in enumerate(("px", "py", "pz", "d"))))
    cells = voxels.point_voxels(rows, 0.1, ("px", "py", "pz"))
    return cells.groupBy(F.col("label").alias("segment"), "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("score"), 6).alias("weight"), F.round(F.sum(F.col("score") * F.col("d")) / F.sum("score"), 6).alias("distance"))


@query()
def voxel_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated signed distances of a ray per feature, walked through the voxels and summed."""
    d = F.col("descriptor")
    rays = features(spark, sf_dir).select(F.col("label").alias("segment"), *(d[i].alias(n) for i, n in enumerate(("px", "py", "pz", "ox", "oy", "oz"))), (F.col("score") + 0.01).alias("weight"))
    return voxels.integrate(rays, voxel=0.05, truncation=0.15)


@query(
    f"""WITH {FEATURES_SQL}, v AS (SELECT row_id, label + 0 AS s, CAST(floor(descriptor[1] / 0.1) AS BIGINT) AS x, CAST(floor(descriptor[2] / 0.1) AS BIGINT) AS y FROM features),
old AS (SELECT s, x, y, count(*) AS seen FROM v WHERE row_id % 2 = 0 GROUP BY s, x, y), cur AS (SELECT s, x, y, count(*) AS samples FROM v WHERE row_id % 2 = 1 GROUP BY s, x, y)
SELECT CAST(cur.s AS INTEGER) AS segment, cur.x AS ix, cur.y AS iy, cur.samples, coalesce(old.seen, 0) AS seen FROM cur LEFT JOIN old ON cur.s = old.s AND cur.x = old.x AND cur.y = old.y"""
)
def voxel_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current voxels with what the same voxels held before."""
    cells = voxels.point_voxels(features(spark, sf_dir).select("row_id", F.col("label").alias("segment"), F.col("descriptor")[0].alias("x"), F.col("descriptor")[1].alias("y"), F.lit(0.0).alias("z")), 0.1)
    half = lambda odd, name: cells.where(F.pmod("row_id", F.lit(2)) == odd).groupBy("segment", "ix", "iy").agg(F.count(F.lit(1)).alias(name))
    return voxels.inherit(half(1, "samples"), half(0, "seen"), ["segment", "ix", "iy"], ["seen"])


@query(
    f"""WITH {FEATURES_SQL}, v AS (SELECT DISTINCT CAST(floor(descriptor[1] / 0.2) AS BIGINT) AS x, CAST(floor(descriptor[2] / 0.2) AS BIGINT) AS y, row_id FROM features)
SELECT x AS ix, y AS iy, count(*) AS crossings FROM v WHERE row_id >= 10 AND EXISTS (SELECT 1 FROM v AS b WHERE b.row_id < 10 AND b.x = v.x AND b.y = v.y) GROUP BY x, y"""
)
def voxel_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-space cells touch only voxels that exist: a semi join."""
    f = features(spark, sf_dir).select("row_id", F.floor(F.col("descriptor")[0] / 0.2).cast("long").alias("ix"), F.floor(F.col("descriptor")[1] / 0.2).cast("long").alias("iy")).distinct()
    return f.where("row_id >= 10").join(f.where("row_id < 10"), ["ix", "iy"], "left_semi").groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("crossings"))


@query()
def alignment_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity alignment of two triples of components within each label."""
    from cairn.operators.alignment import align_groups

    d = F.col("descriptor")
    rows = features(spark, sf_dir).select("label", *(d[i].alias(n) for i, n in enumerate(("sx", "sy", "sz", "tx", "ty", "tz"))))
    return align_groups(rows, "label", ("sx", "sy", "sz"), ("tx", "ty", "tz"))


@query()
def online_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal landmark tracker over each label's frames, as one session each."""
    from cairn.streaming.tracker import track_sessions

    f = features(spark, sf_dir).select(F.col("label").cast("long").alias("session"), "row_id", "feature_id", "descriptor")
    return track_sessions(f, min_similarity=0.3, min_margin=0.01, max_inactive=3)
