"""Accumulation, closed-form distribution fits and standardization of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.config import AIC_SWITCH_THRESHOLD
from panelweave.functions.special import log_gamma, normal_cdf, normal_ppf


def rolling_accumulation(panel: DataFrame, scale: int) -> DataFrame:
    """(node_id, t, acc): trailing sum over ``scale`` days, missing days as zero.

    Null on the first ``scale`` days, and where the window holds no value.
    """
    w = Window.partitionBy("node_id").orderBy("t").rowsBetween(-(scale - 1), 0)
    total, present = F.sum(F.coalesce("value", F.lit(0))).over(w), F.count("value").over(w)
    return panel.select("node_id", "t", F.when((F.col("t") >= scale) & (present > 0), total).cast("double").alias("acc"))


def zero_fraction(acc: DataFrame) -> DataFrame:
    """(node_id, n, zero_fraction) over non-null accumulations."""
    return acc.where("acc IS NOT NULL").groupBy("node_id").agg(F.count("*").alias("n"), F.avg((F.col("acc") == 0).cast("double")).alias("zero_fraction"))


def positive_moments(acc: DataFrame) -> DataFrame:
    """Per node: count, mean, mean logarithm and its sample deviation over positive values; one pass, partial sums."""
    x = F.col("acc")
    return acc.where(x > 0).groupBy("node_id").agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.avg(F.log(x)).alias("mean_log"), F.stddev_samp(F.log(x)).alias("sd_log"), F.sum(F.log(x) * F.log(x)).alias("sum_log2")
    )


def gamma_fit(moments: DataFrame) -> DataFrame:
    """Thom's estimator: (node_id, shape, scale, loglik, aic)."""
    a = F.greatest(F.log("mean") - F.col("mean_log"), F.lit(1e-10))
    fitted = moments.withColumn("_a", a).withColumn("shape", (1 + F.sqrt(1 + 4 * F.col("_a") / 3)) / (4 * F.col("_a"))).withColumn("scale", F.col("mean") / F.col("shape"))
    n, k, b = F.col("n"), F.col("shape"), F.col("scale")
    loglik = n * ((k - 1) * F.col("mean_log") - F.col("mean") / b - log_gamma(k) - k * F.log(b))
    return fitted.withColumn("loglik", loglik).select("node_id", "shape", "scale", "loglik", (4 - 2 * F.col("loglik")).alias("aic"))


def lognormal_fit(moments: DataFrame) -> DataFrame:
    """(node_id, mu, sigma, loglik, aic) from the log-moments; sigma with one degree of freedom less."""
    n, m, s = F.col("n"), F.col("mean_log"), F.col("sd_log")
    squares = F.col("sum_log2") - n * m * m
    loglik = -n * m - n * F.log(s) - n * F.log(F.lit(2 * 3.141592653589793)) / 2 - squares / (2 * s * s)
    return moments.withColumn("loglik", loglik).select("node_id", m.alias("mu"), s.alias("sigma"), "loglik", (4 - 2 * F.col("loglik")).alias("aic"))


def conservative_best(aics: DataFrame, switch: float = AIC_SWITCH_THRESHOLD) -> DataFrame:
    """(node_id, dist_id, best_aic) of rows (node_id, dist_id, aic): the least AIC, ties to the first family.

    Gamma, family 0, stays unless another is better by more than ``switch``. A null AIC is infinite, and -1 stands for
    no finite one.
    """
    best = aics.groupBy("node_id").agg(
        F.min_by("dist_id", F.when(F.col("aic").isNotNull(), F.struct("aic", "dist_id"))).alias("first"), F.min("aic").alias("best_aic"), F.min(F.when(F.col("dist_id") == 0, F.col("aic"))).alias("gamma_aic")
    )
    chosen = F.when(F.col("best_aic").isNull(), -1).when(F.col("gamma_aic") - F.col("best_aic") <= switch, 0).otherwise(F.col("first"))
    return best.select("node_id", chosen.cast("int").alias("dist_id"), "best_aic")


def log_scores(acc: DataFrame, digits: int = 6) -> DataFrame:
    """(node_id, t, z): standardized logarithm, rounded, of positive values; the lognormal index of a record without zeros.

    The moments are grouped by the key that the accumulation's window is partitioned by, so the join shuffles nothing.
    """
    moments = positive_moments(acc).select("node_id", "mean_log", "sd_log")
    x = F.when(F.col("acc") > 0, F.log("acc"))
    return acc.join(moments, "node_id", "left").select("node_id", "t", F.round((x - F.col("mean_log")) / F.col("sd_log"), digits).alias("z"))


def lognormal_goodness(acc: DataFrame) -> DataFrame:
    """(node_id, ppcc, ks_d_upper, ad_a2) of the lognormal fit: correlation with theoretical quantiles, one-sided
    Kolmogorov distance on the grid i/n, Anderson-Darling statistic."""
    moments = positive_moments(acc)
    by_node = Window.partitionBy("node_id").orderBy("acc", "t")
    back = Window.partitionBy("node_id").orderBy(F.desc("acc"), F.desc("t"))
    ranked = acc.where(F.col("acc") > 0).withColumn("i", F.row_number().over(by_node)).withColumn("back", F.row_number().over(back)).join(moments, "node_id")
    cdf = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), normal_cdf((F.log("acc") - F.col("mean_log")) / F.col("sd_log"))))
    scored = ranked.withColumn("f", cdf).withColumn("q", F.exp(F.col("mean_log") + F.col("sd_log") * normal_ppf((F.col("i") - 0.3175) / (F.col("n") + 0.365))))
    # the pair of ln F_i and ln(1 - F_{n+1-i}) has weight 2i - 1: row by row, F has 2i - 1 and 1 - F has 2(n+1-i) - 1
    weighed = (2 * F.col("i") - 1) * F.log("f") + (2 * F.col("back") - 1) * F.log(1 - F.col("f"))
    return scored.groupBy("node_id").agg(
        F.corr("acc", "q").alias("ppcc"), F.max(F.abs(F.col("f") - F.col("i") / F.col("n"))).alias("ks_d_upper"), (-F.max("n") - F.avg(weighed)).alias("ad_a2")
    )


def clipped_index(probability: Column, zero_fraction: Column, value: Column) -> Column:
    """Index of the mix of zeros and a positive distribution: the normal quantile of the mixed probability, clipped."""
    mixed = F.when(value > 0, zero_fraction + (1 - zero_fraction) * probability).otherwise(zero_fraction)
    return normal_ppf(F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), mixed)))
