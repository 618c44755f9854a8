"""Queries on motions, filters, gates, fields and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import motion as M
from cairn.operators import grids, simjoin, tracks
from cairn.plans.bindings import FEATURES_SQL, features
from cairn.plans.matching import loop_shortlist, match_counts
from cairn.plans.registry import query
from cairn.session import checkpoint, run_dir, table
from cairn.sources import stores
from cairn.streaming.tracker import frame_counts


def _numbers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in columns))


@query(
    """SELECT l_orderkey, l_linenumber, round(cos(a / 2), 6) AS c, round(sin(a / 2), 6) AS s, round(q / 2, 6) AS x,
    round(-(cos(a) * q + sin(a) * t), 6) AS back_x, round(a, 6) AS angle FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) * 20 AS a, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS t FROM lineitem)"""
)
def fractional_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each motion, the motion back, and the angle that its logarithm gives."""
    rows = _numbers(spark, sf_dir, "l_discount", "l_quantity", "l_tax")
    zero = F.lit(0.0)
    posed = rows.select("l_orderkey", "l_linenumber", M.rotation_of(zero, zero, F.col("l_discount") * 20).alias("r"), F.array("l_quantity", "l_tax", zero).alias("t"))
    moved = posed.select("l_orderkey", "l_linenumber", M.fraction(F.col("r"), F.col("t"), 0.5).alias("half"), M.inverse(F.col("r"), F.col("t")).alias("back"), M.vector_of(F.col("r")).alias("v"))
    return moved.select("l_orderkey", "l_linenumber", F.round(F.col("half.r")[0], 6).alias("c"), F.round(F.col("half.r")[3], 6).alias("s"), F.round(F.col("half.t")[0], 6).alias("x"), F.round(F.col("back.t")[0], 6).alias("back_x"), F.round(F.col("v")[2], 6).alias("angle"))


@query("SELECT l_orderkey, l_linenumber, round(CAST(l_discount AS DOUBLE) * 3, 9) AS x, round(CAST(l_tax AS DOUBLE) * 3, 9) AS y FROM lineitem")
def undistorted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points distorted by five coefficients and found again."""
    k = (-0.2, 0.05, 0.001, 0.002, 0.01)
    rows = _numbers(spark, sf_dir, "l_discount", "l_tax")
    seen = rows.select("l_orderkey", "l_linenumber", G.brown_distort(F.col("l_discount") * 3, F.col("l_tax") * 3, k).alias("d"))
    back = seen.select("l_orderkey", "l_linenumber", M.brown_undistort(F.col("d.x"), F.col("d.y"), k, steps=60).alias("u"))
    return back.select("l_orderkey", "l_linenumber", F.round("u.x", 9).alias("x"), F.round("u.y", 9).alias("y"))


@query(
    """SELECT l_orderkey, l_linenumber, round(p + g * (m - p), 6) AS value, round((1 - g) * b, 6) AS variance FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 1.07 AS p, CAST(l_extendedprice AS DOUBLE) / 971.3 AS m,
    CASE WHEN CAST(l_tax AS DOUBLE) > 0 THEN CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) ELSE 0.53 END AS b, CASE WHEN CAST(l_tax AS DOUBLE) > 0 THEN (CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE)) / (CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) + 0.53) ELSE 1 END AS g FROM lineitem) WHERE g < 1
    UNION ALL SELECT l_orderkey, l_linenumber, round(CAST(l_extendedprice AS DOUBLE) / 971.3, 6), 0.53 FROM lineitem WHERE CAST(l_tax AS DOUBLE) <= 0"""
)
def filtered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position's prediction updated by its detection; where the flow says nothing the detection is the position."""
    rows = _numbers(spark, sf_dir, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    state = M.updated(F.col("l_quantity") / 1.07, F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice") / 971.3, F.lit(0.53))
    return rows.select("l_orderkey", "l_linenumber", state.alias("u")).select("l_orderkey", "l_linenumber", F.round("u.value", 6).alias("value"), F.round("u.variance", 6).alias("variance"))


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 47 AS a, 0.001 + CAST(l_tax AS DOUBLE) / 97 AS va, CAST(l_extendedprice AS DOUBLE) / 97000 AS b, 0.001 + CAST(l_discount AS DOUBLE) / 89 + 0.0004 * (CAST(l_extendedprice AS DOUBLE) / 97000) ** 2 AS vb FROM lineitem),
f AS (SELECT *, (b - a) * (b - a) <= 9 * (va + vb) AS agree FROM d)
SELECT l_orderkey, l_linenumber, round(CASE WHEN agree THEN (a * vb + b * va) / (va + vb) WHEN vb < va THEN b ELSE a END, 6) AS value, round(greatest(CASE WHEN agree THEN va * vb / (va + vb) WHEN vb < va THEN vb ELSE 2 * va END, pow(0.01 * CASE WHEN agree THEN (a * vb + b * va) / (va + vb) WHEN vb < va THEN b ELSE a END, 2)), 9) AS variance FROM f"""
)
def fused_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse depths fused with a measurement, with the test for outliers and the measurement's share of variance."""
    rows = _numbers(spark, sf_dir, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    made = M.fused(F.col("l_quantity") / 47, 0.001 + F.col("l_tax") / 97, F.col("l_extendedprice") / 97000, 0.001 + F.col("l_discount") / 89, 3.0, 0.01, 0.02)
    return rows.select("l_orderkey", "l_linenumber", made.alias("u")).select("l_orderkey", "l_linenumber", F.round("u.value", 6).alias("value"), F.round("u.variance", 9).alias("variance"))


@query(
    """WITH p AS (SELECT l_suppkey, CAST(l_discount AS DOUBLE) AS x, CAST(l_tax AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) / 10 AS z FROM lineitem), g AS (SELECT *, 500 / z AS a, -500 * x / (z * z) AS c, -500 * y / (z * z) AS d FROM p)
SELECT l_suppkey, count(*) AS points, round(sqrt(sum(1e-6 * ((c * y) ** 2 + (a * z - c * x) ** 2 + (a * y) ** 2 + (d * y - a * z) ** 2 + (d * x) ** 2 + (a * x) ** 2) + 1e-4 * (a * a + c * c + a * a + d * d)) / (2 * count(*))), 6) AS sigma FROM g GROUP BY l_suppkey"""
)
def image_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel error that a pose's covariance means for the points of each frame."""
    covariance = [[(1e-6 if i < 3 else 1e-4) if i == j else 0.0 for j in range(6)] for i in range(6)]
    p = table(spark, sf_dir, "lineitem").select("l_suppkey", M.projected_variance(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.col("l_quantity").cast("double") / 10, 500.0, 500.0, covariance).alias("v"))
    return p.groupBy("l_suppkey").agg(F.count("v").alias("points"), F.round(M.image_sigma(F.col("v")), 6).alias("sigma"))


@query(
    """WITH g AS (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) - 1 > 0 AND CAST(l_tax AS DOUBLE) * 50 <= 3 AND CAST(l_discount AS DOUBLE) * 400 >= 1 AND CAST(l_discount AS DOUBLE) * 400 < 39 AS kept FROM lineitem)
SELECT l_suppkey, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS dropped FROM g GROUP BY l_suppkey"""
)
def triangulation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that pass the gate of a triangulation, by frame: in front, near their images, seen at a fair angle."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax", "l_discount")))
    angle = F.when(F.col("l_discount") * 400 < 39, F.col("l_discount") * 400).otherwise(90.0)
    kept = M.triangulated([F.col("l_quantity")], [F.col("l_quantity") - 1], [F.col("l_tax") * 50], angle)
    return rows.groupBy("l_suppkey").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


@query(
    """SELECT l_suppkey, count(*) AS samples, round(avg(-ln(CAST(l_extendedprice AS DOUBLE) / 1000) - ln(CAST(l_quantity AS DOUBLE))), 6) AS mean_error FROM lineitem WHERE CAST(l_tax AS DOUBLE) > 0 AND CAST(l_quantity AS DOUBLE) > 0 AND CAST(l_extendedprice AS DOUBLE) > 0
GROUP BY l_suppkey HAVING count(*) >= 500"""
)
def audited_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log errors of the frames with 500 depths or more that can be audited."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_tax").cast("double").alias("truth"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_extendedprice").cast("double") / 1000).alias("rho"))
    fine = rows.where(M.audited_depth(F.col("truth"), F.col("rho"), F.col("q")) & (F.col("q") > 0))
    return fine.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(-F.log("rho") - F.log("q")), 6).alias("mean_error")).where("samples >= 500")


_FIELD_SQL = f"""WITH {FEATURES_SQL}, field AS (SELECT r.row_id, cx, cy, sin(cx + r.row_id) AS dx, cos(cy * 2.0 + r.row_id) AS dy FROM (SELECT DISTINCT row_id FROM features) AS r, (SELECT unnest(range(8)) AS cx) AS a, (SELECT unnest(range(8)) AS cy) AS b),
p AS (SELECT row_id, feature_id, least(greatest((x + 50 - 7.5) / 16, 0), 7) AS gx, least(greatest((y + 50 - 7.5) / 16, 0), 7) AS gy FROM features),
c AS (SELECT p.*, i, j, least(floor(gx) + i, 7) AS cx, least(floor(gy) + j, 7) AS cy, (CASE i WHEN 1 THEN gx - floor(gx) ELSE 1 - gx + floor(gx) END) * (CASE j WHEN 1 THEN gy - floor(gy) ELSE 1 - gy + floor(gy) END) AS w FROM p, (SELECT unnest(range(2)) AS i) AS s, (SELECT unnest(range(2)) AS j) AS t)
SELECT c.row_id, feature_id, round(sum(w * dx), 6) AS dx, round(sum(w * dy), 6) AS dy FROM c JOIN field ON field.row_id = c.row_id AND field.cx = c.cx AND field.cy = c.cy GROUP BY c.row_id, feature_id"""


@query(_FIELD_SQL)
def sampled_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse flow field at every feature, bilinear between its cells."""
    f = features(spark, sf_dir).select("row_id", "feature_id", (F.col("x") + 50).alias("x"), (F.col("y") + 50).alias("y"))
    cells = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("cx"), F.lit(j).cast("long").alias("cy")) for i in range(8) for j in range(8))))
    field = f.select("row_id").distinct().select("row_id", cells.alias("c")).select("row_id", "c.*")
    field = field.withColumn("dx", F.sin(F.col("cx") + F.col("row_id"))).withColumn("dy", F.cos(F.col("cy") * 2.0 + F.col("row_id")))
    return grids.sample_field(f, field, ["row_id"], 8, 8, 16).select("row_id", "feature_id", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query(
    """SELECT l_suppkey AS session, l_orderkey AS row_id, count(*) FILTER (WHERE l_returnflag <> 'A') AS new, count(*) FILTER (WHERE l_returnflag = 'A') AS matched, round(avg(CAST(l_discount AS DOUBLE)) FILTER (WHERE l_returnflag = 'A'), 6) AS mean_similarity FROM lineitem GROUP BY l_suppkey, l_orderkey"""
)
def frame_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and matched observations of each frame, and how like the matched ones were."""
    state = F.when(F.col("l_returnflag") == "A", F.lit("matched")).otherwise(F.lit("new"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_orderkey").alias("row_id"), state.alias("state"), F.col("l_discount").cast("double").alias("similarity"))
    return frame_counts(rows).withColumn("mean_similarity", F.round("mean_similarity", 6))


_COUNTS_SQL = f"""WITH {FEATURES_SQL}, s AS (
    SELECT a.row_id AS first, b.row_id AS second, a.feature_id AS left_id, b.feature_id AS right_id, list_cosine_similarity(a.descriptor, b.descriptor) AS score FROM features AS a JOIN features AS b ON a.row_id < b.row_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY first, second, left_id ORDER BY score DESC) AS l, row_number() OVER (PARTITION BY first, second, right_id ORDER BY score DESC) AS r FROM s
), n AS (SELECT first, second, count(*) AS matches FROM r WHERE l = 1 AND r = 1 AND score >= 0.25 GROUP BY first, second)
"""


@query(_COUNTS_SQL + "SELECT first, second, matches FROM n ORDER BY second <> first + 1, matches DESC, first, second LIMIT 1")
def suggested_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair to start with: of adjacent frames the one with most matches, if there is none the best of all."""
    counts = match_counts(spark, sf_dir).select("first", "second", "matches")
    return counts.orderBy(F.col("second") != F.col("first") + 1, F.desc("matches"), "first", "second").limit(1)


@query(
    """WITH seen AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), most AS (SELECT l_orderkey FROM seen GROUP BY l_orderkey ORDER BY count(*) DESC, l_orderkey LIMIT 1), known AS (SELECT l_partkey FROM seen WHERE l_orderkey IN (SELECT l_orderkey FROM most))
SELECT l_orderkey, count(*) AS support FROM seen WHERE l_partkey IN (SELECT l_partkey FROM known) AND l_orderkey NOT IN (SELECT l_orderkey FROM most) GROUP BY l_orderkey ORDER BY support DESC, l_orderkey LIMIT 20"""
)
def next_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty frames that see most of the points that the largest frame sees, in the order in which to try them."""
    seen = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    most = checkpoint(seen.groupBy("l_orderkey").count().orderBy(F.desc("count"), "l_orderkey").limit(1).select("l_orderkey"))
    known = seen.join(F.broadcast(most), "l_orderkey", "left_semi").select("l_partkey")
    support = seen.join(known, "l_partkey", "left_semi").join(F.broadcast(most), "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("support"))
    return support.orderBy(F.desc("support"), "l_orderkey").limit(20)


@query("SELECT l_orderkey, l_linenumber, round(CAST(l_discount AS DOUBLE) * 25, 6) AS rotation, round(CAST(l_tax AS DOUBLE) * 300, 6) AS direction FROM lineitem WHERE CAST(l_discount AS DOUBLE) * 25 > 2 OR CAST(l_tax AS DOUBLE) * 300 > 20")
def bad_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that are more than 2 degrees off in rotation or 20 in direction; an edge too short to have a direction counts by its rotation."""
    rows = _numbers(spark, sf_dir, "l_discount", "l_tax").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 25).alias("rotation"), (F.col("l_tax") * 300).alias("direction"))
    return rows.where((F.col("rotation") > 2) | (F.coalesce("direction", F.lit(0.0)) > 20)).select("l_orderkey", "l_linenumber", F.round("rotation", 6).alias("rotation"), F.round("direction", 6).alias("direction"))


_SHORTLIST_SQL = f"""WITH {FEATURES_SQL}, k AS (SELECT row_id, list(s ORDER BY pos) AS g FROM (
    SELECT row_id, pos, sum(v) AS s FROM (SELECT row_id, unnest(descriptor) AS v, unnest(range(len(descriptor))) AS pos FROM features) GROUP BY row_id, pos) GROUP BY row_id),
p AS (SELECT a.row_id AS row_id, b.row_id AS candidate, round(list_cosine_similarity(a.g, b.g), 9) AS c FROM k AS a JOIN k AS b ON b.row_id <= a.row_id - 3),
short AS (SELECT candidate AS first, row_id AS second FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY c DESC, candidate) AS rank FROM p) WHERE rank <= 5),
s AS (SELECT short.first, short.second, a.feature_id AS left_id, b.feature_id AS right_id, 1 - list_cosine_similarity(a.descriptor, b.descriptor) AS d FROM short JOIN features AS a ON a.row_id = short.first AND a.score >= 0.1 JOIN features AS b ON b.row_id = short.second AND b.score >= 0.1),
r AS (SELECT *, row_number() OVER l AS l, row_number() OVER r AS r, nth_value(d, 2) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ld, nth_value(d, 2) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rd FROM s
    WINDOW l AS (PARTITION BY first, second, left_id ORDER BY d), r AS (PARTITION BY first, second, right_id ORDER BY d))
SELECT first, second, left_id, right_id, round(1 - d, 6) AS score FROM r WHERE l = 1 AND r = 1 AND d < 0.95 * ld AND d < 0.95 * rd"""


@query(_SHORTLIST_SQL)
def shortlisted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame matched with its shortlist alone, by the ratio of cosine distances; weak features are masked."""
    f = features(spark, sf_dir).withColumn("masked", F.col("score") < 0.1)
    pairs = loop_shortlist(spark, sf_dir).select(F.col("candidate").alias("first"), F.col("row_id").alias("second"))
    return simjoin.match_pairs(f, pairs, simjoin.mutual_cosine_ratio(0.95)).select("first", "second", "left_id", "right_id", F.round("score", 6).alias("score"))


@query(f"WITH {FEATURES_SQL} SELECT row_id AS frame_index, count(*) AS features, round(sum(x), 5) AS x, round(max(score), 6) AS best FROM features GROUP BY row_id")
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written to a store and read back by frame, without their descriptors."""
    path = f"{run_dir(spark)}/features-{uuid.uuid4().hex}"
    stores.append_new(features(spark, sf_dir).withColumnRenamed("row_id", "frame_index"), path, ["frame_index", "feature_id"])
    rows = stores.read_frames(spark, path, descriptors=False)
    return rows.groupBy("frame_index").agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("x"), 5).alias("x"), F.round(F.max("score"), 6).alias("best"))


@query(
    f"""WITH {FEATURES_SQL} SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY feature_id) - 1 AS INTEGER) AS index, x, feature_id AS descriptor_row FROM features WHERE score >= 0.3"""
)
def supported_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supported features of each frame with what is lined up with them, numbered anew."""
    lists = F.array_sort(F.collect_list(F.struct("feature_id", "x", (F.col("score") >= 0.3).alias("supported"))))
    frames = features(spark, sf_dir).groupBy("row_id").agg(lists.alias("p"))
    frames = frames.select("row_id", F.col("p.x").alias("x"), F.col("p.feature_id").alias("descriptor_row"), F.col("p.supported").alias("supported"))
    return tracks.supported_points(frames, ["row_id"], "supported", ["x", "descriptor_row"])
