"""Audits of depths against the truth: one scale per frame, errors by how sure the estimates say they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.motion import audited_depth
from cairn.operators.quantiles import quantiles
from cairn.session import checkpoint

#: Limits of the relative standard deviation up to which estimates are told together.
LIMITS = (0.02, 0.05, 0.1, 0.2, 0.5)
#: The median of the absolute value of a standard normal number, to four digits.
MEDIAN_DEVIATION = 0.6745


def scaled(samples: DataFrame, by: list[str], log_error: str, least: int) -> DataFrame:
    """samples with log_scale, the group's median log error, and error, the rest's size; groups of fewer than ``least`` are left out."""
    middle = quantiles(samples, by, log_error, (0.5,)).where(F.col("n") >= least).select(*by, F.col("q0").alias("log_scale"))
    return samples.join(middle, by).withColumn("error", F.abs(F.col(log_error) - F.col("log_scale")))


def depth_errors(samples: DataFrame, by: list[str], least: int = 500) -> DataFrame:
    """(by, error, sigma, log_scale) of the samples (by, truth, rho, variance) that can be audited: errors of log depth after the frame's one scale, and the relative standard deviation that the estimate claims."""
    fine = samples.where(audited_depth(F.col("truth"), F.col("rho"), F.col("variance")) & (F.col("variance") >= 0))
    logs = fine.select(*by, (-F.log("rho") - F.log("truth")).alias("log_error"), (F.sqrt("variance") / F.col("rho")).alias("sigma"))
    return scaled(logs, by, "log_error", least).select(*by, "error", "sigma", "log_scale")


def depth_by_limit(samples: DataFrame, by: list[str], limits: tuple[float, ...] = LIMITS, least: int = 500) -> DataFrame:
    """(sigma_limit, kept, coverage, median_error, within_5, within_10, within_25, calibration): all audited frames' samples surer than each limit.

    coverage is their share of the samples with a true depth in audited frames; calibration the median of error over sigma, 1
    where the claimed deviations are right. A limit that no sample keeps has no row. Frames are (by), with ``least`` samples or more that
    can be audited. Null keys are left out.
    """
    samples = samples.select(*by, "truth", "rho", "variance")
    for b in by:
        samples = samples.where(F.col(b).isNotNull())
    errors = checkpoint(depth_errors(samples, by, least))
    with_truth = samples.where("truth > 0").join(errors.select(*by).distinct(), by, "left_semi").count()
    ratio = F.col("error") / F.greatest("sigma", F.lit(1e-9))
    kept = errors.select(F.explode(F.filter(F.array(*map(F.lit, limits)), lambda x: F.col("sigma") < x)).alias("sigma_limit"), "error", ratio.alias("ratio"))
    share = lambda limit: F.avg((F.col("error") < limit).cast("int"))
    sums = kept.groupBy("sigma_limit").agg(F.count(F.lit(1)).alias("kept"), share(0.05).alias("within_5"), share(0.1).alias("within_10"), share(F.log(F.lit(1.25))).alias("within_25"))
    middle = quantiles(kept, ["sigma_limit"], "error", (0.5,)).select("sigma_limit", F.col("q0").alias("median_error"))
    sure = quantiles(kept, ["sigma_limit"], "ratio", (0.5,)).select("sigma_limit", (F.col("q0") / MEDIAN_DEVIATION).alias("calibration"))
    return sums.join(middle, "sigma_limit").join(sure, "sigma_limit").select("sigma_limit", "kept", (F.col("kept") / with_truth).alias("coverage") if with_truth else F.lit(None).cast("double").alias("coverage"), "median_error", "within_5", "within_10", "within_25", "calibration")


def keyframe_audit(samples: DataFrame, by: list[str], least: int = 50) -> DataFrame:
    """(by, n, scale, median_error, calibration, prior_n, prior_error) of keyframes with ``least`` samples (by, truth, rho, sigma, prior) of a true depth.

    The estimates' inverse depths and the priors' have a scale each, the median of their own log errors; the prior's error is null where fewer
    than ``least`` samples have a prior above 0. Samples whose inverse depth isn't above 0, and null keys, are left out.
    """
    fine = samples.where("truth > 0 and rho > 0").select(*by, (-F.log("rho") - F.log("truth")).alias("log_error"), (F.col("sigma") / F.col("rho")).alias("sigma"), F.when(F.col("prior") > 0, -F.log("prior") - F.log("truth")).alias("log_prior"))
    for b in by:
        fine = fine.where(F.col(b).isNotNull())
    fine = checkpoint(fine)
    own = checkpoint(scaled(fine, by, "log_error", least).withColumn("ratio", F.col("error") / F.greatest("sigma", F.lit(1e-9))))
    prior = checkpoint(scaled(fine.select(*by, "log_prior").where("log_prior is not null"), by, "log_prior", least))
    sums = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.exp(F.max("log_scale")).alias("scale"))
    middle = quantiles(own, by, "error", (0.5,)).select(*by, F.col("q0").alias("median_error"))
    sure = quantiles(own, by, "ratio", (0.5,)).select(*by, (F.col("q0") / MEDIAN_DEVIATION).alias("calibration"))
    before = quantiles(prior, by, "error", (0.5,)).select(*by, F.col("n").alias("prior_n"), F.col("q0").alias("prior_error"))
    return sums.join(middle, by).join(sure, by, "left").join(before, by, "left").withColumn("prior_n", F.coalesce("prior_n", F.lit(0).cast("long")))
