"""Alignment, unions and label text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fellscape.functions.columns import col


def align_xy(x: DataFrame, y: DataFrame, key: str = "sample_id") -> DataFrame:
    """Inputs and responses of the same sample side by side."""
    return x.join(y, key)


def function_grid(fids: DataFrame, instances: Sequence[int]) -> DataFrame:
    """Every function id with every requested instance (a short list from the study settings)."""
    return fids.select("fid", F.explode(F.array(*[F.lit(int(i)) for i in instances])).alias("iid"))


def to_long(df: DataFrame, responses: Sequence[str], label: str = "label", value: str = "y") -> DataFrame:
    """One row per (point, response); an expand on the map side, no shuffle."""
    keep = [col(c) for c in df.columns if c not in set(responses)]
    return df.unpivot(keep, [col(c) for c in responses], label, value)


def union_populations(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_feature_families(families: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Long feature rows of several families; on equal names the later family wins."""
    ranked = reduce(DataFrame.unionByName, [f.withColumn("_family", F.lit(i)) for i, f in enumerate(families)])
    return (ranked.groupBy(*keys, "feature")
            .agg(F.max_by(F.struct("value"), "_family").getField("value").alias("value")))


def split_population(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("kind") == kind)


def split_label(label: str | Column) -> list[Column]:
    """Three parts of ``a_b_c``."""
    parts = F.split(col(label), "_")
    return [F.get(parts, F.lit(i)) for i in range(3)]


def problem_label(name: str | Column) -> Column:
    return F.concat(F.lit("problem_"), col(name))


def benchmark_label(fid: str | Column, iid: str | Column) -> Column:
    return F.format_string("bbob_f%d_ins%d", col(fid).cast("int"), col(iid).cast("int"))


def generated_label(n: str | Column) -> Column:
    return F.format_string("rgf%d", col(n).cast("int"))


def label_contains(df: DataFrame, text: str, label: str = "label") -> DataFrame:
    return df.where(col(label).contains(text))


def kind_of(label: str | Column) -> Column:
    """Population named by a label's prefix."""
    label = col(label)
    return (F.when(label.startswith("problem_"), "problem").when(label.startswith("bbob_"), "bbob")
            .when(label.startswith("rgf"), "rgf"))
