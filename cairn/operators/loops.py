"""Loop candidates: shortlisted pairs of frames whose matches are many and fit one similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.similarity import robust_similarity

#: Matches and inliers that a candidate needs, samples, and candidates that a frame keeps.
LEAST_MATCHES, LEAST_INLIERS, SAMPLES, KEEP = 20, 12, 200, 1


def loop_candidates(matches: DataFrame, source: tuple[str, str, str], target: tuple[str, str, str], threshold: float | str, least_matches: int = LEAST_MATCHES, least_inliers: int = LEAST_INLIERS, samples: int = SAMPLES, keep: int = KEEP) -> DataFrame:
    """(first, second, matches, inliers, s, r, t, rank) of the pairs that pass, the ``keep`` with most inliers for each second frame.

    matches: (first, second) and a matched point's place in either frame, a row per match of the shortlisted pairs. A pair with fewer matches is
    not tried; of the rest a seeded similarity within the threshold (a number or a column) must hold least_inliers. Ties go to more matches, then to the smaller first.
    """
    counts = matches.where("first is not null and second is not null").groupBy("first", "second").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= least_matches)
    tried = matches.join(counts.drop("_m"), ["first", "second"], "left_semi")
    fits = robust_similarity(tried, ["first", "second"], source, target, threshold, samples).where(F.col("inliers") >= least_inliers)
    order = Window.partitionBy("second").orderBy(F.desc("inliers"), F.desc("_m"), "first")
    found = fits.join(counts, ["first", "second"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return found.select("first", "second", F.col("_m").alias("matches"), "inliers", "s", "r", "t", "rank")
