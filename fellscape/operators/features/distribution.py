"""Shape of the response distribution (ela_distr): skewness, kurtosis and number of peaks."""

from __future__ import annotations

from collections.abc import Sequence
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fellscape.functions.columns import col
from fellscape.operators.quantile import exact_quantiles
from fellscape.operators.tables import to_long
from fellscape.session import broadcast_checked

BINS, GRID_POINTS = 1024, 512
PEAK_MASS = 0.1


def moments(df: DataFrame, keys: Sequence[str], y: str, rescaled: bool = False) -> DataFrame:
    """Skewness and excess kurtosis from population moments; a constant response gives NULL.

    ``rescaled`` multiplies the skewness by ``((n - 1) / n) ** 1.5``.
    """
    skew: Column = F.skewness(col(y))
    if rescaled:
        n = F.count(col(y))
        skew = skew * F.pow((n - 1) / n, 1.5)
    return df.groupBy(*keys).agg(skew.alias("ela_distr.skewness"), F.kurtosis(col(y)).alias("ela_distr.kurtosis"))


def bandwidth(sd: Column, iqr: Column, n: Column) -> Column:
    """Silverman's rule; the deviation alone when the middle half is constant."""
    spread = F.when(iqr > 0, F.least(sd, iqr / 1.34)).otherwise(sd)
    return 0.9 * spread * F.pow(n.cast("double"), F.lit(-0.2))


def peaks(df: DataFrame, keys: Sequence[str], y: str, bound: int | None = None) -> DataFrame:
    """``(keys, n_peaks)``: local maxima of a Gaussian kernel density that carry enough mass.

    Values are counted into ``BINS`` equal bins per group, so the density costs ``BINS x
    GRID_POINTS`` kernels per group whatever the number of rows.
    """
    keys = list(keys)
    v = col(y)
    stats = df.groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"),
                                  F.stddev_samp(v).alias("_sd"))
    quart = exact_quantiles(df, keys, y, [0.25, 0.75], bound).groupBy(*keys).agg((F.max("q") - F.min("q")).alias("_iqr"))
    stats = stats.join(quart, keys).withColumn("_h", bandwidth(F.col("_sd"), F.col("_iqr"), F.col("_n")))
    stats = broadcast_checked(stats.where("_h > 0").select(*keys, "_n", "_lo", "_hi", "_h"), bound)
    width = (F.col("_hi") - F.col("_lo")) / BINS
    number = F.least(F.lit(BINS - 1), F.floor((v - F.col("_lo")) / width)).cast("int")
    bins = (df.select(*keys, v.alias(y)).join(stats, keys).where(v.isNotNull())
            .groupBy(*keys, "_n", "_lo", "_hi", "_h", number.alias("_bin")).agg(F.count(F.lit(1)).alias("_c")))

    start, span = F.col("_lo") - 3 * F.col("_h"), (F.col("_hi") - F.col("_lo")) + 6 * F.col("_h")
    middle = F.col("_lo") + (F.col("_bin") + 0.5) * width
    at = start + span * F.col("_g") / (GRID_POINTS - 1)
    kernel = F.exp(-0.5 * F.pow((at - middle) / F.col("_h"), 2)) / (F.col("_h") * math.sqrt(2 * math.pi))
    density = (bins.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))))
               .groupBy(*keys, "_g").agg((F.sum(F.col("_c") * kernel) / F.first("_n")).alias("_f"),
                                         F.first(span / (GRID_POINTS - 1)).alias("_step")))

    along = W.partitionBy(*keys).orderBy("_g")
    before, after = F.lag("_f").over(along), F.lead("_f").over(along)
    marked = density.withColumn("_min", (F.col("_f") < before) & (F.col("_f") <= after)).withColumn(
        "_max", (F.col("_f") > F.coalesce(before, F.lit(-1.0))) & (F.col("_f") >= F.coalesce(after, F.lit(-1.0))))
    hill = F.sum(F.col("_min").cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0))
    hills = (marked.withColumn("_hill", F.coalesce(hill, F.lit(0)))
             .groupBy(*keys, "_hill").agg(F.sum(F.col("_f") * F.col("_step")).alias("_mass"), F.max("_max").alias("_top")))
    return hills.groupBy(*keys).agg(F.count_if((F.col("_mass") >= PEAK_MASS) & F.col("_top")).cast("double").alias("n_peaks"))


def distribution_features(points: DataFrame, labels: Sequence[str], bound: int | None = None) -> DataFrame:
    """``ela_distr.*`` of every response."""
    rows = to_long(points.select("rep", *[col(c) for c in labels]), labels)
    keys = ["rep", "label"]
    shape = moments(rows, keys, "y").join(
        peaks(rows, keys, "y", bound).withColumnRenamed("n_peaks", "ela_distr.number_of_peaks"), keys, "left")
    names = ["ela_distr.skewness", "ela_distr.kurtosis", "ela_distr.number_of_peaks"]
    return to_long(shape, names, "feature", "value").select("rep", "label", "feature", "value")
