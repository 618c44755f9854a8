"""Queries of the evaluation kind: drift, relative errors, depth audits, neighbours, assignment, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import scalars as S
from cairn.operators import assignment, asof, epipolar, grids, simjoin
from cairn.operators.quantiles import quantiles
from cairn.plans.bindings import EVENTS_SQL, FEATURES_SQL, events, features
from cairn.plans.matching import RADIUS_CANDIDATES_SQL, cosine_edges, radius_candidates
from cairn.plans.registry import query
from cairn.session import checkpoint, table


def _round_sql(n: int) -> str:
    """One round of proposals as CTEs: what is still free, each a's cheapest, each b's cheapest proposal."""
    free = f"f{n} AS (SELECT * FROM f{n - 1} WHERE (row_id, a_id) NOT IN (SELECT row_id, a_id FROM t{n - 1}) AND (row_id, b_id) NOT IN (SELECT row_id, b_id FROM t{n - 1}))" if n else f"f0 AS ({RADIUS_CANDIDATES_SQL})"
    return f"""{free},
p{n} AS (SELECT row_id, a_id, b_id, cost FROM (SELECT *, row_number() OVER (PARTITION BY row_id, a_id ORDER BY cost, b_id) AS r FROM f{n}) WHERE r = 1),
t{n} AS (SELECT row_id, a_id, b_id, cost FROM (SELECT *, row_number() OVER (PARTITION BY row_id, b_id ORDER BY cost, a_id) AS r FROM p{n}) WHERE r = 1)"""


@query("WITH " + ", ".join(_round_sql(n) for n in range(4)) + " " + " UNION ALL ".join(f"SELECT row_id, a_id, b_id, cost, {n} AS round FROM t{n}" for n in range(4)))
def assigned_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one assignment of the radius candidates by rounds of proposals."""
    return assignment.propose_accept(checkpoint(radius_candidates(spark, sf_dir).select("row_id", "a_id", "b_id", "cost")), ["row_id"])


@query(
    f"""WITH {FEATURES_SQL}, r AS (SELECT row_id, feature_id, CASE WHEN score >= 0.66 THEN 0 WHEN score >= 0.33 THEN 1 ELSE 2 END AS class, score FROM features)
SELECT row_id, feature_id, class, CAST(slot AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY class, score DESC, feature_id) - 1 AS slot FROM r) WHERE slot < 20"""
)
def slot_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a frame: matched before coasted before new, the strongest first, at most twenty."""
    kind = F.when(F.col("score") >= 0.66, 0).when(F.col("score") >= 0.33, 1).otherwise(2)
    rows = features(spark, sf_dir).select("row_id", "feature_id", kind.alias("class"), "score")
    return assignment.layout(rows, ["row_id"], F.col("class"), [F.desc("score"), F.col("feature_id")], 20).select("row_id", "feature_id", "class", "slot")


@query()
def pair_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epipolar verification of the matches of every pair of frames."""
    f = features(spark, sf_dir)
    edges = cosine_edges(spark, sf_dir).select("first", "second", "left_id", "right_id")
    ends = edges.join(f.select(F.col("row_id").alias("first"), F.col("feature_id").alias("left_id"), F.col("x").alias("x1"), F.col("y").alias("y1")), ["first", "left_id"])
    ends = ends.join(f.select(F.col("row_id").alias("second"), F.col("feature_id").alias("right_id"), F.col("x").alias("x2"), F.col("y").alias("y2")), ["second", "right_id"])
    return epipolar.verify_pairs(ends, threshold=3.0)


@query(
    f"""WITH {FEATURES_SQL}, k AS (SELECT row_id, avg(x) AS x, avg(y) AS y FROM features GROUP BY row_id), n AS (
SELECT a.row_id, b.row_id AS neighbour, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 9) AS d2 FROM k AS a JOIN k AS b ON b.row_id < a.row_id - 1 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, neighbour) AS rank FROM n) SELECT row_id, neighbour, round(sqrt(d2), 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def keyframe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier frames, not adjacent, whose centre is near: the ten nearest, by a grid join."""
    k = checkpoint(features(spark, sf_dir).groupBy("row_id").agg(F.avg("x").alias("ax"), F.avg("y").alias("ay")))
    a = k.select(F.col("row_id").alias("a_id"), "ax", "ay", F.lit(0).alias("map"))
    b = k.select(F.col("row_id").alias("b_id"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.lit(0).alias("map"))
    near = simjoin.radius_join(a, b, 3.0, ["map"], cost=F.round("d2", 9), keep=1 << 30).where("b_id < a_id - 1")
    w = Window.partitionBy("a_id").orderBy("cost", "b_id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(F.col("a_id").alias("row_id"), F.col("b_id").alias("neighbour"), F.round(F.sqrt("cost"), 6).alias("distance"), "rank")


@query(
    f"""WITH {EVENTS_SQL}, p AS (SELECT a.user_id, a.event_id, b.value - a.value AS step, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t, b.event_id) AS n, b.t - a.t - 3600 AS late FROM timed AS a JOIN timed AS b ON a.user_id = b.user_id AND b.t >= a.t + 3600)
SELECT user_id, count(*) AS pairs, round(sqrt(avg(step * step)), 6) AS rms FROM p WHERE n = 1 AND late <= 7200 GROUP BY user_id"""
)
def relative_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square change over an hour, per stream."""
    e = events(spark, sf_dir).select("event_id", "user_id", "t", "value")
    pairs = asof.forward(e.withColumn("due", F.col("t") + 3600), e, ["user_id"], "due", "t", ["event_id", "value"], clamp=False)
    steps = pairs.where(F.col("right_time") - F.col("t") - 3600 <= 7200).withColumn("step", F.col("right_value") - F.col("value"))
    return steps.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sqrt(F.avg(F.col("step") * F.col("step"))), 6).alias("rms"))


@query(
    f"""WITH {EVENTS_SQL}, q AS (SELECT user_id, value, ntile(4) OVER (PARTITION BY user_id ORDER BY t, event_id) AS quarter FROM timed)
SELECT user_id, CAST(quarter AS INTEGER) AS quarter, count(*) AS n, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS spread FROM q GROUP BY user_id, quarter"""
)
def drift_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = events(spark, sf_dir).select("user_id", "value", F.ntile(4).over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("quarter"))
    return q.groupBy("user_id", "quarter").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))


@query(
    """WITH r AS (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) / (CAST(l_quantity AS DOUBLE) * 1000) AS ratio, CAST(l_tax AS DOUBLE) AS sigma FROM lineitem), s AS (SELECT l_suppkey, quantile_cont(ratio, 0.5) AS scale FROM r GROUP BY l_suppkey HAVING count(*) >= 100)
SELECT r.l_suppkey, count(*) AS n, round(any_value(scale), 4) AS scale, round(quantile_cont(abs(ratio / scale - 1), 0.5), 4) AS median_error, round(avg(CAST(abs(ratio / scale - 1) < 0.1 AS INT)), 6) AS within_10 FROM r JOIN s USING (l_suppkey) GROUP BY r.l_suppkey"""
)
def depth_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A median scale per keyframe of a hundred samples or more, then the errors under it."""
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice").cast("double") / (F.col("l_quantity").cast("double") * 1000)).alias("ratio"))
    s = checkpoint(quantiles(r, ["l_suppkey"], "ratio", (0.5,)).where("n >= 100").select("l_suppkey", F.col("q0").alias("scale")))
    e = r.join(s, "l_suppkey").withColumn("error", F.abs(F.col("ratio") / F.col("scale") - 1))
    middle = quantiles(e, ["l_suppkey"], "error", (0.5,)).select("l_suppkey", F.round("q0", 4).alias("median_error"))
    sums = e.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("scale"), 4).alias("scale"), F.round(F.avg((F.col("error") < 0.1).cast("int")), 6).alias("within_10"))
    return sums.join(middle, "l_suppkey").select("l_suppkey", "n", "scale", "median_error", "within_10")


@query(
    f"""WITH {FEATURES_SQL}, g AS (SELECT unnest(range(4)) AS gx), h AS (SELECT unnest(range(4)) AS gy), p AS (
SELECT row_id, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, score, greatest((x - (gx + 0.5) * 25) ** 2 + (y - (gy + 0.5) * 25) ** 2, 1.0) AS d2 FROM features, g, h)
SELECT row_id, gx, gy, round(sum(score / (d2 * d2)) / sum(1 / (d2 * d2)), 6) AS value, round(sqrt(min(d2)), 6) AS nearest FROM p GROUP BY row_id, gx, gy"""
)
def anchor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's anchors spread over a grid by inverse distance."""
    a = features(spark, sf_dir).select("row_id", "x", "y", F.col("score").alias("value"))
    return grids.inverse_distance(a, ["row_id"], 4, 4, 25.0).withColumns({"value": F.round("value", 6), "nearest": F.round("nearest", 6)})


_CELLS = f"WITH {FEATURES_SQL}, c AS (SELECT label, CAST(floor(x / 10) AS BIGINT) AS x, CAST(floor(y / 10) AS BIGINT) AS y, avg(score) AS value, 1.0 / count(*) AS variance FROM features GROUP BY 1, 2, 3)"


@query(
    _CELLS
    + """SELECT a.label, a.x, a.y, round(sum(b.value / b.variance) / sum(1 / b.variance), 6) AS mean, count(*) AS n FROM c AS a JOIN c AS b ON a.label = b.label AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.label, a.x, a.y"""
)
def regularised_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-variance means over each cell's 3 by 3 neighbourhood."""
    cell = lambda c: F.floor(F.col(c) / 10).cast("long").alias(c)
    c = features(spark, sf_dir).groupBy("label", cell("x"), cell("y")).agg(F.avg("score").alias("value"), (1.0 / F.count(F.lit(1))).alias("variance"))
    return grids.neighbourhood_mean(c, ["label"]).withColumn("mean", F.round("mean", 6))


@query(
    """WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT count(*) AS tracks, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, count(*) FILTER (WHERE n >= 10) AS at_least_10, count(*) FILTER (WHERE n >= 30) AS at_least_30, count(*) FILTER (WHERE n >= 100) AS at_least_100 FROM n"""
)
def track_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    longer = [F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (10, 30, 100)]
    sums = n.agg(F.count(F.lit(1)).alias("tracks"), F.round(F.avg("n"), 6).alias("mean"), *longer)
    middle = quantiles(n, [], "n", (0.5, 0.9)).select(F.round("q0", 6).alias("median"), F.round("q1", 6).alias("p90"))
    return sums.join(F.broadcast(middle), F.lit(True), "left").select("tracks", "mean", "median", "p90", *(f"at_least_{k}" for k in (10, 30, 100)))  # one row each


@query("SELECT l_partkey, min(l_orderkey) AS first_frame, max(l_orderkey) AS last_frame, count(DISTINCT l_orderkey) AS frames FROM lineitem GROUP BY l_partkey HAVING max(l_orderkey) >= (SELECT max(l_orderkey) FROM lineitem) - 2000")
def active_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sighting of the landmarks that were seen in the last frames."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    last = lines.agg(F.max("l_orderkey")).first()[0] or 0
    seen = lines.groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_frame"), F.max("l_orderkey").alias("last_frame"), F.countDistinct("l_orderkey").alias("frames"))
    return seen.where(F.col("last_frame") >= last - 2000)


@query(
    f"""WITH {FEATURES_SQL}, s AS (SELECT row_id, count(*) FILTER (WHERE score > 0.5) AS support, count(DISTINCT CAST(floor(x / 25) AS INT)) / 4.0 AS coverage, avg(abs(x - y)) AS angle FROM features GROUP BY row_id)
SELECT row_id, round(support * coverage * least(angle, 15), 6) AS score FROM s ORDER BY support * coverage * least(angle, 15) DESC, row_id LIMIT 50"""
)
def ranked_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best seeds by support, coverage and angle."""
    s = features(spark, sf_dir).groupBy("row_id").agg(F.count_if(F.col("score") > 0.5).alias("support"), (F.countDistinct(F.floor(F.col("x") / 25)) / 4.0).alias("coverage"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("angle"))
    scored = s.select("row_id", S.seed_score(F.col("support"), F.col("coverage"), F.col("angle")).alias("score"))
    return scored.orderBy(F.desc("score"), "row_id").limit(50).withColumn("score", F.round("score", 6))


@query(
    """SELECT l_returnflag AS reason, count(*) AS rejected, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean_quantity, CAST(round(avg(l_linenumber * 30 % 256)) AS INTEGER) AS red FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag"""
)
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by reason, with a mean colour channel rounded half away from zero."""
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return lines.groupBy(F.col("l_returnflag").alias("reason")).agg(F.count(F.lit(1)).alias("rejected"), F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("mean_quantity"), F.round(F.avg(F.pmod(F.col("l_linenumber") * 30, F.lit(256)))).cast("int").alias("red"))


@query(
    """SELECT o_orderkey, c_custkey AS point, n_name AS source_track FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'"""
)
def final_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where final points come from: two joins along their keys."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, "c_custkey").join(n, "n_nationkey").select("o_orderkey", F.col("c_custkey").alias("point"), F.col("n_name").alias("source_track"))


@query(
    """WITH p AS (SELECT l_partkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_partkey)
SELECT a.l_partkey AS first, b.l_partkey AS second, len(list_intersect(a.s, b.s)) AS shared FROM p AS a JOIN p AS b ON a.l_partkey + 1 = b.l_partkey WHERE list_has_any(a.s, b.s)"""
)
def overlapping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring tracks whose sets overlap, by a join of their elements."""
    s = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    b = s.select((F.col("l_partkey") - 1).alias("l_partkey"), "l_suppkey")
    both = s.join(b, ["l_partkey", "l_suppkey"]).groupBy(F.col("l_partkey").alias("first")).agg(F.count(F.lit(1)).alias("shared"))
    return both.select("first", (F.col("first") + 1).alias("second"), "shared")


@query(
    """WITH g AS (SELECT user_id, value, unnest([0.5, 1.0, 2.0]) AS k FROM events) SELECT CAST(k AS DOUBLE) AS k, CAST(floor(user_id / 10) AS BIGINT) AS cell, round(avg(k * value + 1 / (1 + value * value)), 6) AS cost, count(*) AS pairs FROM g GROUP BY 1, 2"""
)
def cost_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cost of every grid value, all pairs at once."""
    g = table(spark, sf_dir, "events").select("user_id", "value", F.explode(F.array(*(F.lit(x) for x in (0.5, 1.0, 2.0)))).alias("k"))
    cost = F.col("k") * F.col("value") + 1 / (1 + F.col("value") * F.col("value"))
    return g.groupBy("k", F.floor(F.col("user_id") / 10).alias("cell")).agg(F.round(F.avg(cost), 6).alias("cost"), F.count(F.lit(1)).alias("pairs"))


@query(
    """SELECT l_orderkey, l_linenumber, round(degrees(acos(greatest(-1, least(1, (x * y + y * z + z * x) / (x * x + y * y + z * z))))), 6) AS angle,
round(x * (1 + r * (-0.2 + r * (0.05 + r * 0.01))) + 2 * 0.001 * x * y + 0.002 * (r + 2 * x * x), 9) AS dx, round(500 / (2 * tan(radians(60) / 2)), 6) AS focal
FROM (SELECT *, x * x + y * y AS r FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) + 0.01 AS x, CAST(l_tax AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) / 50 AS z FROM lineitem))"""
)
def ray_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallax of two rays, radial-tangential distortion and the focal length of a field of view."""
    x, y, z = F.col("l_discount").cast("double") + 0.01, F.col("l_tax").cast("double"), F.col("l_quantity").cast("double") / 50
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(G.ray_angle([x, y, z], [y, z, x]), 6).alias("angle"), F.round(G.brown_distort(x, y, (-0.2, 0.05, 0.001, 0.002, 0.01))["x"], 9).alias("dx"), F.round(G.focal_from_fov(500, 60.0), 6).alias("focal"))


@query(
    """WITH r AS (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS ratio FROM lineitem), q AS (SELECT l_suppkey, quantile_cont(ratio, 0.25) AS a, quantile_cont(ratio, 0.5) AS m, quantile_cont(ratio, 0.75) AS b FROM r GROUP BY l_suppkey)
SELECT l_suppkey, count(*) AS n, round(m, 4) AS median, count(*) FILTER (WHERE abs(ratio / m - 1) <= 0.25) AS near, any_value(b) <= 1.3 * any_value(a) AND count(*) FILTER (WHERE abs(ratio / m - 1) <= 0.25) >= 20 AS consistent FROM r JOIN q USING (l_suppkey) GROUP BY l_suppkey, m"""
)
def depth_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.operators.alignment import consistent_groups

    r = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("ratio"))
    return consistent_groups(r, "l_suppkey", "ratio").withColumn("median", F.round("median", 4))


@query(
    """SELECT l_orderkey, l_linenumber, round(cos(CAST(l_discount AS DOUBLE) + o_custkey / 1000.0), 6) AS c, round(sin(CAST(l_discount AS DOUBLE) + o_custkey / 1000.0), 6) AS s,
round(cos(CAST(l_discount AS DOUBLE)) * CAST(o_totalprice AS DOUBLE) / 100000 + CAST(l_quantity AS DOUBLE), 9) AS x, round(sin(CAST(l_discount AS DOUBLE)) * CAST(o_totalprice AS DOUBLE) / 100000 + CAST(l_tax AS DOUBLE), 9) AS y
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def composed_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's pose is its motion from the keyframe after the keyframe's pose."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_totalprice").cast("double").alias("price"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in ("l_discount", "l_quantity", "l_tax")))
    zero = F.lit(0.0)
    pose = G.compose(G.yaw(F.col("l_discount")), F.array("l_quantity", "l_tax", zero), G.yaw(F.col("o_custkey") / 1000.0), F.array(F.col("price") / 100000, zero, zero))
    p = lines.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", pose.alias("p"))
    return p.select("l_orderkey", "l_linenumber", F.round(F.col("p.r")[0], 6).alias("c"), F.round(F.col("p.r")[3], 6).alias("s"), F.round(F.col("p.t")[0], 9).alias("x"), F.round(F.col("p.t")[1], 9).alias("y"))


@query(
    """SELECT l_orderkey, l_partkey, p_size, round(CAST(l_quantity AS DOUBLE) / p_size, 6) AS inverse_depth FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND p_size > 1e-6"""
)
def depth_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inlier observations of landmarks in front of the camera."""
    seen = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") != "R").select("l_orderkey", F.col("l_partkey"), F.col("l_quantity").cast("double").alias("q"))
    marks = table(spark, sf_dir, "part").where("p_size > 1e-6").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return seen.join(marks, "l_partkey").select("l_orderkey", "l_partkey", "p_size", F.round(F.col("q") / F.col("p_size"), 6).alias("inverse_depth"))


@query(
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#/].*$', '') AS site, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://|/$|[.]html$', '', 'g') AS path FROM pages)
SELECT path, min(page_id) AS first_page, count(*) AS pages, any_value(site) AS site FROM p GROUP BY path"""
)
def pages_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with the same resolved path are one: its first page and how many there are."""
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://|/$|[.]html$", "")
    site = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#/].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), site.alias("site"))
    return p.groupBy("path").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("pages"), F.min("site").alias("site"))


@query(
    f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, CAST(floor(t / 3600) % 24 AS BIGINT) AS hour, avg(value) AS cost FROM timed GROUP BY 1, 2), n AS (SELECT user_id, hour, cost, lag(cost) OVER w AS l, lead(cost) OVER w AS r FROM c WINDOW w AS (PARTITION BY user_id ORDER BY hour))
SELECT user_id, hour, round(CASE WHEN l - 2 * cost + r > 0 THEN greatest(-0.5, least(0.5, (l - r) / (2 * (l - 2 * cost + r)))) ELSE 0 END, 4) AS shift FROM n WHERE cost < l AND cost < r"""
)
def refined_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local minima of a cost curve, refined by a parabola."""
    c = events(spark, sf_dir).groupBy("user_id", F.pmod(F.floor(F.col("t") / 3600), F.lit(24)).cast("long").alias("hour")).agg(F.avg("value").alias("cost"))
    w = Window.partitionBy("user_id").orderBy("hour")
    n = c.withColumn("l", F.lag("cost").over(w)).withColumn("r", F.lead("cost").over(w)).where("cost < l and cost < r")
    shift, rounded = G.parabola_minimum(F.col("l"), F.col("cost"), F.col("r")), F.round("at", 4)
    # a shift below zero keeps its sign when it is rounded to zero, as in SQL
    return n.select("user_id", "hour", shift.alias("at")).select("user_id", "hour", F.when((F.col("at") < 0) & (rounded == 0), F.lit(-0.0)).otherwise(rounded).alias("shift"))


@query()
def motion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user's events, spaced pairs with enough change in value."""
    from cairn.operators.alignment import motion_pairs as pairs

    return pairs(events(spark, sf_dir), "user_id", "event_id", "value", 20.0)
