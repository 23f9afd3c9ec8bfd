"""Exact quantiles of large groups: a sketch brackets each quantile, counts settle it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from fellscape.functions.columns import col
from fellscape.session import broadcast_checked

ACCURACY = 50_000  # the sketch errs by at most n / ACCURACY ranks


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    bound: int | None = None) -> DataFrame:
    """``(keys, prob, q)`` with linear interpolation between neighbours.

    The sketch gives two values that enclose the quantile up to its direct neighbours. Then rows
    below and above are counted, keeping their nearest value, and rows inside are counted per
    distinct value, so neither all values of a group nor the copies of a frequent value meet in
    one task. ``bound`` limits the number of groups, when known.
    """
    keys = list(keys)
    margin = 4.0 / ACCURACY
    marks = [F.lit(max(p - margin, 0.0)) for p in probs] + [F.lit(min(p + margin, 1.0)) for p in probs]
    v, k = col(value), len(probs)
    sketch = df.groupBy(*keys).agg(F.percentile_approx(v, F.array(*marks), ACCURACY).alias("_m"), F.count(v).alias("_n"),
                                   F.min(v).alias("_min"), F.max(v).alias("_max"))
    brackets = F.array(*[F.struct(
        F.lit(float(p)).alias("prob"),
        (F.col("_min") if p <= margin else F.get("_m", F.lit(i))).alias("_lo"),
        (F.col("_max") if p >= 1 - margin else F.get("_m", F.lit(k + i))).alias("_hi")) for i, p in enumerate(probs)])
    marked = sketch.select(*keys, "_n", F.explode(brackets).alias("_b")).select(*keys, "_n", "_b.*")
    marked = broadcast_checked(marked, None if bound is None else bound * k)
    zone = F.when(v < F.col("_lo"), -1).when(v > F.col("_hi"), 1).otherwise(0)
    nearest = F.when(F.col("_zone") < 0, F.max(v)).otherwise(F.min(v))
    counts = (df.select(*keys, v.alias(value)).where(v.isNotNull()).join(marked, keys).withColumn("_zone", zone)
              .groupBy(*keys, "prob", "_n", "_zone", F.when(F.col("_zone") == 0, v).alias("_in"))
              .agg(F.count(F.lit(1)).alias("_c"), nearest.alias("_v")))
    upto = W.partitionBy(*keys, "prob").orderBy("_zone", "_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("_cum", F.sum("_c").over(upto))
    place = (F.col("_n") - 1) * F.col("prob")
    low = F.floor(place)
    at = lambda r: F.min(F.when(F.col("_cum") > r, F.col("_v")))
    found = ranked.groupBy(*keys, "prob").agg(
        at(low).alias("_a"), at(F.least(low + 1, F.col("_n") - 1)).alias("_b"), F.first(place - low).alias("_t"))
    return found.select(*keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("q"))
