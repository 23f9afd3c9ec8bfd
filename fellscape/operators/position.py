"""Exact positions (ranks) over a whole table without a single-task sort.

Rows are cut into buckets that follow the order, buckets are counted, the counts are summed
into offsets, and only then are rows numbered inside their bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fellscape.functions.columns import col
from fellscape.session import broadcast_checked


def hex_digits(n: int, rows_per_bucket: int = 100_000) -> int:
    """Leading hex digits of a hash that keep a bucket near ``rows_per_bucket`` rows."""
    return min(7, max(1, math.ceil(math.log(max(n / rows_per_bucket, 1.0), 16))))


def hex_bucket(h: Column, digits: int, start: int = 1) -> Column:
    return F.conv(F.substring(h, start, digits), 16, 10).cast("int")


def position_in_buckets(df: DataFrame, bucket: Column, order: Sequence[Column | str], out: str,
                        keys: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """0-based position within ``keys``; ``bucket`` never decreases along ``order``.

    The offsets table has one row per bucket; it is written and counted before it is broadcast.
    ``source`` may name a cheaper table with the same rows to count the buckets from.
    """
    counted = (source if source is not None else df).withColumn("_bucket", bucket)
    df = df.withColumn("_bucket", bucket)
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (counted.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return (df.join(broadcast_checked(offsets), [*keys, "_bucket"])
            .withColumn(out, F.col("_offset") + inside - 1).drop("_bucket", "_offset"))


def add_position(df: DataFrame, order: str, out: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """Position by a unique numeric column; bucket borders are its approximate quantiles, as many as the rows need."""
    buckets = min(10_000, max(16, math.ceil(df.count() / rows_per_bucket)))
    probs = [i / buckets for i in range(1, buckets)]
    borders = df.agg(F.percentile_approx(col(order), probs, max(10_000, 10 * buckets))).first()[0] or []
    border_list = F.array(*[F.lit(b) for b in sorted(set(borders))]) if borders else None
    bucket = F.lit(0) if border_list is None else F.size(F.filter(border_list, lambda b: b < col(order)))
    return position_in_buckets(df, bucket, [col(order)], out)
