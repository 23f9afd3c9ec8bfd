"""From feature tables of the three populations to distances, clusters and an embedding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window as W, functions as F

from fellscape.functions.columns import col
from fellscape.operators import clean, cluster, embed, standardize, tables, tiles
from fellscape.operators.standardize import Standardized
from fellscape.session import cut

# Features left out of the analysis.
LEFT_OUT = ["pca.expl_var.cov_x", "pca.expl_var.cor_x", "pca.expl_var_PC1.cov_x", "pca.expl_var_PC1.cor_x",
            "pca.expl_var.cov_init", "pca.expl_var.cor_init"]


def without_left_out(features: DataFrame) -> DataFrame:
    """Infinities to NULL, principal-component features left out."""
    return clean.drop_cols_by_regex(clean.inf_to_null(features), LEFT_OUT)


def merge_populations(problem: DataFrame, bbob: DataFrame, rgf: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One column set for all, infinities to NULL, principal-component features left out, split again."""
    merged = without_left_out(tables.union_populations([problem, bbob, rgf]))
    return tuple(tables.split_population(merged, kind) for kind in ("problem", "bbob", "rgf"))


@dataclass(frozen=True)
class Analysis:
    """Results of :func:`analyze`."""

    standardized: Standardized
    threshold: float
    merges: DataFrame
    clusters: DataFrame
    embedding: DataFrame
    nearest: DataFrame


def complete_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in clean.any_null(clean.column_profile(df, columns))]


def cluster_analysis(s: Standardized) -> tuple[float, DataFrame, DataFrame]:
    """Threshold, merges and flat clusters of the benchmark and problem rows.

    The threshold is the mean distance between benchmark functions over all selected columns;
    columns with missing values are dropped afterwards, on the union.
    """
    threshold = tiles.mean_distance(s.bbob, "label", s.features).first()["mean_dist"]
    both = tables.union_populations([s.bbob.withColumn("kind", F.lit("bbob")), s.problem.withColumn("kind", F.lit("problem"))])
    columns = complete_columns(both, s.features)
    numbered = cut(both.select("label", "kind", *[col(c) for c in columns]).withColumn(
        "leaf", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("kind", "label")) - 1))  # one row per function
    rounds = cluster.ward_rounds(numbered, columns, "leaf")
    flat = cluster.cut_clusters(numbered.select("label", "kind", "leaf"), rounds, threshold, "leaf")
    return threshold, rounds, flat


def embed_populations(s: Standardized) -> DataFrame:
    rows = tables.union_populations([getattr(s, kind).withColumn("kind", F.lit(kind)) for kind in ("bbob", "problem", "rgf")])
    return embed.embed_2d(rows, complete_columns(rows, s.features))


def analyze(features: DataFrame, columns: Sequence[str], k: int = 3) -> Analysis:
    """From a wide feature table (``label, kind, fid`` and features) to distances, clusters and an embedding."""
    merged = cut(without_left_out(features))  # one row per label and repeat
    kinds = [tables.split_population(merged, kind) for kind in ("problem", "bbob", "rgf")]
    used = [c for c in columns if c in kinds[0].columns]
    s = standardize.standardize_populations(*kinds, used)
    s = replace(s, problem=cut(s.problem), bbob=cut(s.bbob), rgf=cut(s.rgf))
    threshold, merges, clusters = cluster_analysis(s)
    return Analysis(s, threshold, merges, clusters, embed_populations(s),
                    standardize.nearest_benchmark(s.problem, s.bbob, s.features, k))
