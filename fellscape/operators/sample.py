"""Seeded subsamples of exact size, without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fellscape.functions.columns import col, key_hash

PREFIX = 4  # hex digits of a bucket: 65,536 buckets per repeat


def expected_sample_size(n: Column, ratio: float) -> Column:
    return F.ceil(n * F.lit(float(ratio))).cast("long")


def check_subsample(ratio: float, repeats: int) -> None:
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"ratio must lie between 0 and 1, not {ratio}")
    if repeats <= 0:
        raise ValueError(f"repeats must be positive, not {repeats}")


def refused(ratio: Column, repeats: Column) -> Column:
    """The same rule for a table of settings: true where a subsample would be refused."""
    return ~F.coalesce((ratio > 0) & (ratio < 1) & (repeats > 0), F.lit(False))


def _cutting_bucket(counts: DataFrame, bucket: str, need: Column) -> DataFrame:
    """Per repeat, the bucket in which the wanted number of rows is reached, and how many it gives."""
    run = W.partitionBy("rep").orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    cum = counts.withColumn("_cum", F.sum("_n").over(run)).withColumn("_need", need)
    return (cum.where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_n") < F.col("_need")))
            .select("rep", bucket, (F.col("_need") - F.col("_cum") + F.col("_n")).alias("_left")))


def subsample(df: DataFrame, id_col: str, ratio: float = 0.8, repeats: int = 2, seed: int = 42) -> DataFrame:
    """``ceil(n * ratio)`` rows per repeat: those with the smallest seeded hash of their id.

    The largest chosen hash is found by bucket counts and a sort of the rows of one bucket in
    16 ** 4, then every row is kept or dropped by comparing its hash: the table itself is never
    shuffled. The broadcast tables hold one row per repeat. The same rows are chosen for every
    response, since the hash knows only seed, repeat and id.
    """
    check_subsample(ratio, repeats)
    rep = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")
    hashed = lambda d: d.withColumn("_h", key_hash((F.lit(seed) + F.col("rep")).cast("string"), col(id_col)))
    keyed = hashed(df.select(rep, col(id_col))).select("rep", id_col, "_h", F.substring("_h", 1, PREFIX).alias("_p"))
    counts = keyed.groupBy("rep", "_p").agg(F.count(F.lit(1)).alias("_n"))
    need = expected_sample_size(F.sum("_n").over(W.partitionBy("rep")), ratio)
    last = (keyed.join(F.broadcast(_cutting_bucket(counts, "_p", need)), ["rep", "_p"])
            .withColumn("_rank", F.row_number().over(W.partitionBy("rep").orderBy("_h", id_col)))
            .where("_rank = _left").select("rep", F.col("_h").alias("_top"), F.col(id_col).alias("_top_id")))
    chosen = hashed(df.select(rep, "*")).join(F.broadcast(last), "rep")
    below = (F.col("_h") < F.col("_top")) | ((F.col("_h") == F.col("_top")) & (col(id_col) <= F.col("_top_id")))
    return chosen.where(below).select("rep", *[col(c) for c in df.columns])


def full_sample(df: DataFrame) -> DataFrame:
    """Every row, as repeat 0."""
    return df.select(F.lit(0).alias("rep"), "*")
