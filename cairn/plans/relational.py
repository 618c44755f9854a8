"""Queries on the relational and event tables: joins, aggregates, windows, pages, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import scalars as S
from cairn.operators import alignment, asof, paging, tracks
from cairn.operators.quantiles import quantiles
from cairn.plans.bindings import EVENTS_SQL, events
from cairn.plans.registry import query
from cairn.session import checkpoint, table

# Joins


@query("SELECT l_orderkey, l_linenumber, p_partkey, p_brand, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey")
def observation_landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their landmarks."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_partkey", "p_brand", "l_quantity")


@query("SELECT l_partkey, o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def landmark_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames in which each landmark was seen."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "l_linenumber")


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_nationkey, n_name")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with its count of matching suppliers, zero included; counted before the join."""
    counts = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("s_suppkey").alias("suppliers"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(counts, "n_nationkey", "left").fillna(0, ["suppliers"])


@query(
    """WITH seen AS (SELECT DISTINCT l_partkey AS landmark, l_orderkey AS frame FROM lineitem)
SELECT landmark, frame, list(frame) OVER (PARTITION BY landmark ORDER BY frame RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS trail FROM seen"""
)
def landmark_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sighting of a landmark with those of the 500 frames up to it."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("landmark"), F.col("l_orderkey").alias("frame")).distinct()
    w = Window.partitionBy("landmark").orderBy("frame").rangeBetween(-500, 0)
    return seen.withColumn("trail", F.sort_array(F.collect_list("frame").over(w)))


@query(
    """WITH seen AS (SELECT DISTINCT l_orderkey AS frame, l_partkey AS landmark FROM lineitem)
SELECT a.frame AS first, b.frame AS second, count(*) AS shared FROM seen AS a JOIN seen AS b ON a.landmark = b.landmark AND a.frame > b.frame + 1 GROUP BY a.frame, b.frame HAVING count(*) >= 2"""
)
def covisibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of frames, not neighbours, that share two landmarks or more.

    The sightings are written first, so both sides of the join are plain exchanges: adaptive
    execution can split the frames of a landmark that is seen very often.
    """
    seen = checkpoint(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("landmark")).distinct())
    a, b = seen.withColumnRenamed("frame", "first"), seen.withColumnRenamed("frame", "second")
    return a.join(b, "landmark").where("first > second + 1").groupBy("first", "second").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


@query(
    """WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS votes FROM lineitem GROUP BY l_partkey, l_suppkey), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_suppkey) AS k FROM n)
SELECT l_partkey, l_suppkey, votes FROM r WHERE k = 1"""
)
def most_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier with most lines for each part, ties to the lower id."""
    votes = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("l_partkey").agg(F.max(F.struct("votes", (-F.col("l_suppkey")).alias("minus"))).alias("best"))
    return best.select("l_partkey", (-F.col("best.minus")).alias("l_suppkey"), "best.votes")


@query(
    """WITH n AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS a, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS b FROM n) WHERE a = 1 AND b = 1"""
)
def identity_conflicts_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose both ends have no other link in the frame."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    a, b = Window.partitionBy("l_orderkey", "l_partkey"), Window.partitionBy("l_orderkey", "l_suppkey")
    return n.withColumn("a", F.count(F.lit(1)).over(a)).withColumn("b", F.count(F.lit(1)).over(b)).where("a = 1 and b = 1").drop("a", "b")


@query(
    """WITH kept AS (SELECT l_partkey, l_orderkey FROM lineitem WHERE l_discount < 0.05), many AS (SELECT l_partkey FROM kept GROUP BY l_partkey HAVING count(*) >= 10)
SELECT l_partkey, dense_rank() OVER (ORDER BY l_partkey) - 1 AS point, count(*) AS observations FROM kept WHERE l_partkey IN (SELECT l_partkey FROM many) GROUP BY l_partkey"""
)
def retained_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with ten retained observations or more, numbered densely in order of their ids."""
    counts = table(spark, sf_dir, "lineitem").where("l_discount < 0.05").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("observations")).where("observations >= 10")
    return tracks.dense_ids(counts, "l_partkey", "point").select("l_partkey", "point", "observations")


# As-of joins

_ASOF = f"WITH {EVENTS_SQL}, a AS (SELECT event_id, user_id, t FROM timed WHERE event_type = 'click'), b AS (SELECT event_id, user_id, t FROM timed WHERE event_type = 'view')"


def _click_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir).select("event_id", "user_id", "t", "event_type")
    return e.where("event_type = 'click'").drop("event_type").withColumn("_row", F.col("event_id")), e.where("event_type = 'view'").drop("event_type")


@query(
    _ASOF
    + """, r AS (SELECT a.event_id, b.event_id AS right_event_id, abs(a.t - b.t) AS gap, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id) AS n FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 1800)
SELECT event_id, right_event_id, round(gap, 6) AS gap FROM r WHERE n = 1"""
)
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's nearest view within half an hour."""
    a, b = _click_view(spark, sf_dir)
    found = asof.nearest(a, b, ["user_id"], "t", "t", 1800.0, ["event_id"])
    return found.select("event_id", "right_event_id", F.round(F.abs(F.col("t") - F.col("right_time")), 6).alias("gap"))


@query(
    _ASOF
    + """, f AS (SELECT a.event_id, b.event_id AS r, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t, b.event_id) AS n FROM a JOIN b ON a.user_id = b.user_id AND b.t >= a.t),
l AS (SELECT user_id, max_by(event_id, (t, event_id)) AS r FROM b GROUP BY user_id)
SELECT a.event_id, coalesce(f.r, l.r) AS right_event_id FROM a LEFT JOIN f ON f.event_id = a.event_id AND f.n = 1 LEFT JOIN l ON l.user_id = a.user_id"""
)
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's first view at or after it, clamped to the last."""
    a, b = _click_view(spark, sf_dir)
    return asof.forward(a.drop("_row"), b, ["user_id"], "t", "t", ["event_id"]).select("event_id", "right_event_id")


@query(
    f"""WITH {EVENTS_SQL}, p AS (SELECT a.event_id, b.event_id AS right_event_id, b.t - a.t - 3600 AS late, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t, b.event_id) AS n
FROM timed AS a JOIN timed AS b ON a.user_id = b.user_id AND b.t >= a.t + 3600) SELECT event_id, right_event_id, round(late, 6) AS late FROM p WHERE n = 1 AND late <= 7200"""
)
def asof_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's first one an hour or more later, if within two hours more."""
    e = events(spark, sf_dir).select("event_id", "user_id", "t")
    found = asof.forward(e.withColumn("due", F.col("t") + 3600), e, ["user_id"], "due", "t", ["event_id"], clamp=False)
    return found.withColumn("late", F.col("right_time") - F.col("t") - 3600).where("late <= 7200").select("event_id", "right_event_id", F.round("late", 6).alias("late"))


# Windows over ordered streams


@query(
    f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, t, event_id, value, CASE WHEN t - lag(t) OVER w <= 7200 THEN 0 ELSE 1 END AS fresh FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, round(max(t) - min(t), 6) AS seconds FROM s GROUP BY user_id, session"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions split at two hours without an event."""
    e = asof.sessions(events(spark, sf_dir).select("user_id", "t", "event_id"), ["user_id"], "t", 7200.0, "event_id")
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.round(F.max("t") - F.min("t"), 6).alias("seconds"))


@query(
    f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, t - lag(t) OVER w AS dt, abs(value - lag(value) OVER w) AS step FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, count(*) AS events, count(*) FILTER (WHERE dt <= 0) AS not_increasing, round(sum(step), 4) AS path, round(max(dt), 6) AS longest_gap FROM g GROUP BY user_id"""
)
def stream_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotonic time, path length and the longest gap of each stream."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    g = events(spark, sf_dir).select("user_id", (F.col("t") - F.lag("t").over(w)).alias("dt"), F.abs(F.col("value") - F.lag("value").over(w)).alias("step"))
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("dt") <= 0).alias("not_increasing"), F.round(F.sum("step"), 4).alias("path"), F.round(F.max("dt"), 6).alias("longest_gap"))


@query(
    f"""WITH {EVENTS_SQL}, n AS (SELECT user_id, event_id, t, CASE WHEN event_type = 'purchase' THEN value END AS v FROM timed), k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1 FROM n
WINDOW b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE v0 END, 4) AS filled FROM k WHERE v0 IS NOT NULL AND v1 IS NOT NULL"""
)
def gap_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the events between two purchases, filled linearly in time."""
    known = F.col("v").isNotNull()
    n = events(spark, sf_dir).select("user_id", "event_id", "t", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    k = n.withColumns({"v0": F.last("v", True).over(back), "t0": F.last(F.when(known, F.col("t")), True).over(back), "v1": F.first("v", True).over(ahead), "t1": F.first(F.when(known, F.col("t")), True).over(ahead)})
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    filled = F.when(known, F.col("v")).when(F.col("t1") > F.col("t0"), between).otherwise(F.col("v0"))
    return k.where("v0 is not null and v1 is not null").select("event_id", F.round(filled, 4).alias("filled"))


@query("SELECT CAST(epoch(date_trunc('hour', CAST(ts AS TIMESTAMP))) AS BIGINT) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums by type."""
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "event_type", "events", "total")


@query(
    f"""WITH {EVENTS_SQL}, f AS (SELECT user_id, CAST(floor(t / 604800) AS BIGINT) AS week, min(CAST(floor(t / 604800) AS BIGINT)) OVER (PARTITION BY user_id) AS cohort FROM timed)
SELECT cohort, week - cohort AS age, count(DISTINCT user_id) AS survivors FROM f GROUP BY 1, 2"""
)
def cohort_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the users first seen in a week are seen in each later one."""
    weeks = events(spark, sf_dir).select("user_id", F.floor(F.col("t") / 604800).alias("week")).distinct()
    first = weeks.groupBy("user_id").agg(F.min("week").alias("cohort"))
    return weeks.join(first, "user_id").groupBy("cohort", (F.col("week") - F.col("cohort")).alias("age")).agg(F.count(F.lit(1)).alias("survivors"))


@query(
    """WITH p AS (SELECT o_custkey AS track, o_orderkey, CAST(o_totalprice AS DOUBLE) AS x FROM orders), s AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY track ORDER BY o_orderkey)) AS d FROM p)
SELECT track, count(*) AS n, round(coalesce(sum(d), 0), 2) AS length, round(abs(max_by(x, o_orderkey) - min_by(x, o_orderkey)), 2) AS closure FROM s GROUP BY track"""
)
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path length and start-to-end distance of each track."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), "o_orderkey", F.col("o_totalprice").cast("double").alias("x"))
    return alignment.path_length(p, ["track"], "o_orderkey", ("x",)).select("track", "n", F.round("length", 2).alias("length"), F.round("closure", 2).alias("closure"))


# Aggregates


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS high, count(*) FILTER (WHERE value IS NULL) AS missing, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("high"), F.count_if(F.col("value").isNull()).alias("missing"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("SELECT max(event_id) AS last_id, count(*) AS n, coalesce(round(sum(value), 4), 0) AS total, coalesce(sum(length(props)), 0)::BIGINT AS bytes FROM events WHERE event_type <> 'none'")
def store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'none'").agg(F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.sum("value"), 4), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.length("props")), F.lit(0)).cast("long").alias("bytes"))


@query(
    """WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT CAST(CASE WHEN n <= 16 THEN n - 1 WHEN n <= 32 THEN 16 ELSE least(23, 16 + ceil(log2(n / 32.0))) END AS BIGINT) AS bin, count(*) AS tracks FROM n GROUP BY 1"""
)
def track_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.length_histogram(table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")))


@query(
    """SELECT l_returnflag, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95), 4) AS p95,
round(list_sort(list(CAST(l_extendedprice AS DOUBLE)))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1], 4) AS nearest_rank_90 FROM lineitem GROUP BY l_returnflag"""
)
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact linear percentiles and a nearest rank, from counts of equal values."""
    found = quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.5, 0.95), (0.9,))
    return found.select("l_returnflag", F.round("q0", 4).alias("median"), F.round("q1", 4).alias("p95"), F.round("r0", 4).alias("nearest_rank_90"))


@query(
    """WITH e AS (SELECT CAST(l_discount AS DOUBLE) AS sigma, abs(CAST(l_extendedprice AS DOUBLE) - 30000) / 30000 AS error FROM lineitem), r AS (SELECT lim, sigma, error FROM e, (SELECT unnest([0.02, 0.05, 0.1]) AS lim) WHERE sigma <= lim + 1e-9)
SELECT CAST(lim AS DOUBLE) AS sigma_limit, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 6) AS coverage, round(quantile_cont(error, 0.5), 6) AS median_error, round(avg(CAST(error < 0.25 AS INT)), 6) AS within_25 FROM r GROUP BY lim"""
)
def error_by_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative rollup: errors of all rows up to each limit of sigma."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("double").alias("sigma"), (F.abs(F.col("l_extendedprice").cast("double") - 30000) / 30000).alias("error"))
    total = e.count()
    limits = F.explode(F.filter(F.array(*(F.lit(x) for x in (0.02, 0.05, 0.1))), lambda x: F.col("sigma") <= x + 1e-9))
    within = e.withColumn("sigma_limit", limits)
    middle = quantiles(within, ["sigma_limit"], "error", (0.5,)).select("sigma_limit", "q0")
    r = within.groupBy("sigma_limit").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("error") < 0.25).cast("int")).alias("w")).join(middle, "sigma_limit")
    return r.select("sigma_limit", "n", F.round(F.col("n") / max(total, 1), 6).alias("coverage"), F.round("q0", 6).alias("median_error"), F.round("w", 6).alias("within_25"))


@query("SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 6) AS mean, round(max(s_acctbal) - min(s_acctbal), 6) AS spread FROM supplier WHERE NOT isnan(s_acctbal) GROUP BY s_nationkey")
def mean_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").where(~F.isnan("s_acctbal"))
    return rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal"), 6).alias("mean"), F.round(F.max("s_acctbal") - F.min("s_acctbal"), 6).alias("spread"))


@query(
    """WITH n AS (SELECT o_orderstatus AS segment, count(*) AS size FROM orders GROUP BY o_orderstatus) SELECT segment, size, size = (SELECT max(size) FROM n) AS largest FROM n"""
)
def segment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("segment")).agg(F.count(F.lit(1)).alias("size"))
    return n.join(F.broadcast(n.agg(F.max("size").alias("most"))), F.lit(True)).select("segment", "size", (F.col("size") == F.col("most")).alias("largest"))


@query("SELECT l_partkey, round(sum(CAST(l_extendedprice AS DOUBLE) / (0.01 + CAST(l_tax AS DOUBLE))) / sum(1 / (0.01 + CAST(l_tax AS DOUBLE))), 4) AS fused, round(count(*) / sum(1 / (0.01 + CAST(l_tax AS DOUBLE))), 6) AS variance FROM lineitem GROUP BY l_partkey")
def inverse_variance_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-variance weighted mean with the harmonic mean of the variances."""
    v, x = F.lit(0.01) + F.col("l_tax").cast("double"), F.col("l_extendedprice").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(x / v) / F.sum(1 / v), 4).alias("fused"), F.round(F.count(F.lit(1)) / F.sum(1 / v), 6).alias("variance"))


@query(
    """WITH r AS (SELECT l_orderkey, list_filter([CASE WHEN count(*) < 3 THEN 'few' END, CASE WHEN avg(CAST(l_discount AS DOUBLE)) > 0.07 THEN 'steep' END, CASE WHEN sum(CAST(l_quantity AS DOUBLE)) < 60 THEN 'small' END], lambda x: x IS NOT NULL) AS reasons FROM lineitem GROUP BY l_orderkey)
SELECT array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible, count(*) AS orders FROM r GROUP BY 1, 2"""
)
def degeneracy_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the tests they fail; eligible where none.

    A mean that is the limit but for its last digits is told by its sum in the table's order, as one thread of SQL
    adds it, and not by how the rows were dealt out; a running sum reads these groups as a stream.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").cast("double").alias("d"), F.col("l_quantity").cast("double").alias("q"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    sums = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.sum("q").alias("quantity"))
    close = sums.where(F.abs(F.col("mean") - 0.07) <= 1e-12).select("l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = lines.where("d is not null").join(close, "l_orderkey", "left_semi").select("l_orderkey", F.sum("d").over(order).alias("s"), F.count("d").over(order).alias("k"))
    told = told.groupBy("l_orderkey").agg((F.max_by("s", "k") / F.max("k")).alias("told"))
    tests = F.array(F.when(F.col("n") < 3, F.lit("few")), F.when(F.coalesce("told", "mean") > 0.07, F.lit("steep")), F.when(F.col("quantity") < 60, F.lit("small")))
    r = sums.join(told, "l_orderkey", "left").select(F.array_compact(tests).alias("why"))
    return r.groupBy(F.array_join("why", ",").alias("reasons"), (F.size("why") == 0).alias("eligible")).agg(F.count(F.lit(1)).alias("orders"))


# Pages, order and sets


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 101")
def page_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(table(spark, sf_dir, "orders"), ["o_orderkey"], (1000,), 100).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 500 OR (l_orderkey = 500 AND l_linenumber > 1) ORDER BY l_orderkey, l_linenumber LIMIT 51")
def page_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], (500, 1), 50).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 250")
def row_at_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.ordinal(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 250)


@query("SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) WHERE position % 10 = 0 AND position < 3000")
def strided_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth frame, 300 of them."""
    return paging.every_nth(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10, 300)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def strongest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP) DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each key, as an upsert leaves it; an aggregate, so it combines before the shuffle."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return e.select("user_id", "m.event_id", "m.event_type")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-ignore: the union by key, each key once."""
    o = table(spark, sf_dir, "orders")
    a = table(spark, sf_dir, "customer").select("c_custkey").join(o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return a.unionByName(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))).dropDuplicates(["c_custkey"])


@query("SELECT a, b, count(*) AS n FROM (SELECT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem UNION ALL SELECT l_partkey % 50, l_suppkey FROM lineitem) GROUP BY a, b")
def symmetric_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pairs in both directions; summed once, then mirrored."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.pmod("l_partkey", F.lit(50)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return n.union(n.select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


# Scalars


@query("SELECT p_partkey, left(trim(regexp_replace(p_name, '[^a-zA-Z0-9_-]+', '-', 'g'), '-'), 48) AS slug FROM part")
def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


@query(
    """SELECT p_partkey, CAST((CAST(p_partkey AS HUGEINT) * 2654435761 % 4294967296) % 192 + 64 AS INTEGER) AS r, CAST(((CAST(p_partkey AS HUGEINT) * 2654435761 % 4294967296) // 256) % 192 + 64 AS INTEGER) AS g,
CAST(((CAST(p_partkey AS HUGEINT) * 2654435761 % 4294967296) // 65536) % 192 + 64 AS INTEGER) AS b FROM part"""
)
def part_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.colour(F.col("p_partkey")).alias("c")).select("p_partkey", "c.*")


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS fingerprint FROM events""")
def event_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identity: SHA-256 of sorted-key JSON."""
    return table(spark, sf_dir, "events").select("event_id", S.fingerprint("user_id", "event_type", "event_id").alias("fingerprint"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS key, length(props) AS size FROM events")
def event_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("key"), F.length("props").cast("long").alias("size"))


@query(
    """SELECT l_orderkey, l_linenumber, round(500 * x / z + 320, 6) AS u, round(500 * y / z + 240, 6) AS v, round(z, 6) AS depth, z > 1e-6 AND (500 * x / z) * (500 * x / z) + (500 * y / z) * (500 * y / z) <= 90000 AS near_centre
FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS x, CAST(l_tax AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS z FROM lineitem)"""
)
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinhole projection and the reprojection test."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.project(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.col("l_quantity").cast("double"), 500, 500, 320, 240).alias("p"))
    near = G.reprojects(F.col("p.u"), F.col("p.v"), F.col("p.depth"), F.lit(320.0), F.lit(240.0), 300.0)
    return p.select("l_orderkey", "l_linenumber", F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"), F.round("p.depth", 6).alias("depth"), near.alias("near_centre"))


@query(
    """SELECT l_orderkey, l_linenumber, round(x / (1 - 0.2 * (x * x + y * y)), 9) AS ux, round(y / (1 - 0.2 * (x * x + y * y)), 9) AS uy, round(x, 9) AS bx, round(y, 9) AS by_
FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS x, CAST(l_tax AS DOUBLE) AS y FROM lineitem)"""
)
def distortion_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division-model undistortion and its closed-form inverse."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.division_undistort(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), -0.2).alias("u"))
    p = p.withColumn("b", G.division_distort(F.col("u.x"), F.col("u.y"), -0.2))
    return p.select("l_orderkey", "l_linenumber", F.round("u.x", 9).alias("ux"), F.round("u.y", 9).alias("uy"), F.round("b.x", 9).alias("bx"), F.round("b.y", 9).alias("by_"))


@query(
    """SELECT l_orderkey, l_linenumber, round(abs(x2 * (0.1 * y1 - 0.3) + y2 * (-0.1 * x1 + 0.2) + (0.3 * x1 - 0.2 * y1)) / sqrt((0.1 * y1 - 0.3) ** 2 + (-0.1 * x1 + 0.2) ** 2 + (-0.1 * y2 + 0.3) ** 2 + (0.1 * x2 - 0.2) ** 2), 6) AS error
FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE) AS y1, CAST(l_quantity AS DOUBLE) / 50 AS x2, CAST(l_linenumber AS DOUBLE) / 7 AS y2 FROM lineitem)"""
)
def sampson_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [0.0, 0.1, -0.3, -0.1, 0.0, 0.2, 0.3, -0.2, 0.0]
    e = G.sampson_error(m, F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.col("l_quantity").cast("double") / 50, F.col("l_linenumber").cast("double") / 7)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(e, 6).alias("error"))


@query(
    """SELECT event_id, round(CASE WHEN abs(value - 50) <= 10 THEN 1.0 ELSE 10 / abs(value - 50) END, 6) AS weight, round(1 - exp(-25.0 / (2 * (1 + value) * (1 + value))), 6) AS confidence, round((value * 0.02) ** 2 + (0.5 * 4) ** 2, 6) AS keyframe FROM events WHERE value >= 0"""
)
def robust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "events").where("value >= 0"), F.col("value")
    return e.select("event_id", F.round(S.huber_weight(v - 50, 10.0), 6).alias("weight"), F.round(S.confidence(1 + v, 5.0), 6).alias("confidence"), F.round(S.keyframe_score(v, F.lit(0.005), F.lit(0.5), 4.0), 6).alias("keyframe"))
