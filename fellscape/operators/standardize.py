"""Means, feature selection and standardisation of the three populations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from fellscape.functions.columns import col
from fellscape.operators.clean import clean_table, drop_rows_any_null
from fellscape.operators.correlate import drop_correlated
from fellscape.session import broadcast_checked, cut


def select_shared_features(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Long feature rows whose feature is in ``kept``."""
    return rows.join(broadcast_checked(kept), "feature", "left_semi")


def mean_by(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean of every column per key over instances and repeats, missing values skipped."""
    return df.groupBy(col(key)).agg(*[F.avg(col(c)).alias(c) for c in columns])


def mean_by_fid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return mean_by(df, "fid", columns)


def mean_by_label(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return mean_by(df, "label", columns)


def zscore_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, mean, sd)`` with the population deviation; a constant column gets deviation 1."""
    row = df.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(col(c)).alias("mean"), F.stddev_pop(col(c)).alias("sd"))
                   .alias(f"f{k}") for k, c in enumerate(columns)])
    cells = row.select(F.explode(F.array(*[F.col(f"f{k}") for k in range(len(columns))])).alias("f")).select("f.*")
    return cells.select("feature", "mean", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sd"))


def zscore_transform(df: DataFrame, params: DataFrame) -> DataFrame:
    """Standardise the fitted columns; one parameter row per column is read on the driver."""
    fit = {r["feature"]: (r["mean"], r["sd"]) for r in params.collect()}
    return df.select(*[((col(c) - F.lit(fit[c][0])) / F.lit(fit[c][1])).alias(c) if c in fit else col(c) for c in df.columns])


@dataclass(frozen=True)
class Standardized:
    """The three populations on the benchmark's scale, one row per label."""

    problem: DataFrame
    bbob: DataFrame
    rgf: DataFrame
    features: list[str]
    report: DataFrame


def standardize_populations(problem: DataFrame, bbob: DataFrame, rgf: DataFrame, columns: Sequence[str],
                            threshold: float = 0.95) -> Standardized:
    """Select features on the benchmark means, then put all populations on the benchmark's scale.

    Benchmark: means by function, infinities to NULL, incomplete and constant columns dropped,
    correlated columns dropped. Generated functions with a missing value are dropped.
    """
    means = cut(mean_by_fid(bbob, columns))  # at most 24 rows, used by every step below
    kept, _ = clean_table(means, inf_as_null=True, cols_all_null=True, cols_any_null=True, cols_constant=True,
                          duplicate_rows=False, id_columns=["fid"])
    chosen, report = drop_correlated(kept, [c for c in kept.columns if c != "fid"], threshold)
    features = [c for c in chosen.columns if c != "fid"]
    params = zscore_fit(chosen, features)
    bench = zscore_transform(chosen, params).select(
        F.concat(F.lit("f"), F.col("fid").cast("string")).alias("label"), *[col(c) for c in features])
    others = []
    for table in (problem, rgf):
        others.append(zscore_transform(mean_by_label(table, features), params))
    return Standardized(others[0], bench, drop_rows_any_null(others[1], features), features, report)


def nearest_benchmark(problem: DataFrame, bbob: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """The ``k`` benchmark functions closest to each problem.

    The benchmark side has at most 24 rows per feature: it is broadcast once its size is checked,
    and every problem cell meets at most 24 partners before the sum.
    """
    def cells(df, label):
        return (df.unpivot([col("label")], [col(c) for c in columns], "feature", "value")
                .withColumnRenamed("label", label))

    bench = cells(bbob, "benchmark").withColumnRenamed("value", "other")
    gaps = (cells(problem, "label").join(broadcast_checked(bench), "feature")
            .groupBy("label", "benchmark").agg(F.sqrt(F.sum((F.col("value") - F.col("other")) ** 2)).alias("dist")))
    rank = F.row_number().over(W.partitionBy("label").orderBy("dist", "benchmark"))
    return gaps.withColumn("rank", rank).where(F.col("rank") <= k)
