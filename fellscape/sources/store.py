"""Feature, catalogue and response tables on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from fellscape.operators.tables import kind_of


#: Columns of the features of a study as CSV; the population and the label are folders.
STORED = "rep int, feature string, value double, fid int, iid int, kind string, label string"


def write_features(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per population and label, so that a rerun replaces only the labels it has.

    Rows are first brought together by label, to write one file per label instead of one per
    task and label; a label holds at most (features x repeats) rows.
    """
    (features.repartition("kind", "label").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("kind", "label").format(fmt).option("header", True).save(path))


def read_features(spark: SparkSession, path: str, labels: Sequence[str] | None = None, fmt: str = "parquet", schema: str = STORED) -> DataFrame:
    """All features, or those of the requested labels (pruned to their folders); ``schema`` is that of CSV files."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.format(fmt).schema(schema).option("header", True).load(path)
    return df.where(F.col("label").isin(list(labels))) if labels is not None else df


def requested_status(requested: DataFrame, present: DataFrame) -> DataFrame:
    """Requested labels without rows: an error for problem and benchmark labels, skipped for generated ones."""
    missing = requested.join(present.select("label").distinct(), "label", "left_anti")
    return missing.select(
        "label", kind_of("label").alias("kind"),
        F.when(kind_of("label") == "rgf", "skipped").otherwise("error").alias("status"))


def read_features_tolerant(features: DataFrame, requested: DataFrame) -> DataFrame:
    """Features of the requested labels; a missing problem or benchmark label raises."""
    errors = requested_status(requested, features).where("status = 'error'").select("label")
    absent = [r["label"] for r in errors.limit(20).collect()]
    if absent:
        raise FileNotFoundError(f"no features for {absent}")
    return features.join(requested.select("label").distinct(), "label", "left_semi")


def write_catalogue(catalogue: DataFrame, responses: DataFrame, path: str) -> None:
    """Generated functions and their values at the sample points."""
    catalogue.write.mode("overwrite").parquet(f"{path}/catalogue")
    responses.write.mode("overwrite").parquet(f"{path}/responses")


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/catalogue"), spark.read.parquet(f"{path}/responses")
