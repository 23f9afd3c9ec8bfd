"""Correlation of feature columns and removal of correlated ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fellscape.functions.columns import col
from fellscape.operators.ranks import kendall, spearman
from fellscape.session import cut

METHODS = ("pearson", "spearman", "kendall")
MODES = ("pair", "direct")
TIE = 1e-9



def _named(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    return pairs.select(
        F.col("i").alias("ord_a"), F.col("j").alias("ord_b"),
        F.get(names, F.col("i")).alias("feat_a"), F.get(names, F.col("j")).alias("feat_b"), "r")


def _pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments of all column pairs, summed inside each task, then over tasks.

    Columns are first shifted by their means, so the sums keep their digits.
    """
    means = df.agg(*[F.avg(col(c)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    left, right = np.triu_indices(len(columns), k=1)

    def partial(batches):
        acc = 0
        for pdf in batches:
            x = pdf.to_numpy(float) - shift
            known = ~np.isnan(x)
            z, m = np.where(known, x, 0.0), known.astype(float)
            acc = acc + np.stack([m.T @ m, z.T @ m, m.T @ z, (z * z).T @ m, m.T @ (z * z), z.T @ z])
        if isinstance(acc, np.ndarray):
            cells = acc[:, left, right]
            yield pd.DataFrame({"i": left, "j": right, **{f"s{k}": cells[k] for k in range(6)}})

    slim = df.select(*[col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    sums = (slim.mapInPandas(partial, "i int, j int, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double")
            .groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)]))
    n, sa, sb, qa, qb, ab = [F.col(f"s{k}") for k in range(6)]
    va, vb = n * qa - sa * sa, n * qb - sb * sb
    return sums.select("i", "j", F.try_divide(n * ab - sa * sb, F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0)))).alias("r"))


def corr_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Upper triangle ``(ord_a, ord_b, feat_a, feat_b, r)``, pairwise complete; constants give NULL."""
    if method not in METHODS:
        raise ValueError(f"{method} is not defined, use one of {METHODS}")
    how = {"pearson": _pearson, "spearman": spearman, "kendall": kendall}[method]
    return _named(how(df, list(columns)), columns)


def upper_triangle(square: DataFrame) -> DataFrame:
    return square.where("ord_a < ord_b")


def corr_pairs(corr: DataFrame, threshold: float) -> DataFrame:
    """Pairs with ``abs(r) >= threshold``; A is the later column, B the earlier."""
    return (corr.where(F.abs("r") >= F.lit(float(threshold)))
            .select(F.col("feat_b").alias("feat_a"), F.col("feat_a").alias("feat_b"), F.col("r").alias("corr_pair")))


def corr_pair_report(corr: DataFrame, threshold: float) -> DataFrame:
    """For each correlated pair, the mean ``abs(r)`` of either column with all columns but the two."""
    both = corr.select(F.col("feat_a").alias("feature"), "r").unionAll(corr.select(F.col("feat_b").alias("feature"), "r"))
    sums = both.groupBy("feature").agg(F.sum(F.abs("r")).alias("s"), F.count("r").alias("n"))
    own = F.abs("corr_pair")

    def side(name):
        mean = F.try_divide(F.col(f"s_{name}") - own, F.col(f"n_{name}") - 1)
        return F.when(F.col(f"n_{name}") > 1, mean).alias(f"corr_{name}_mean")

    out = corr_pairs(corr, threshold)
    for name in ("a", "b"):
        out = out.join(sums.select(F.col("feature").alias(f"feat_{name}"), F.col("s").alias(f"s_{name}"),
                                   F.col("n").alias(f"n_{name}")), f"feat_{name}")
    return out.select("feat_a", "feat_b", side("a"), side("b"), "corr_pair")


def drop_list(report: DataFrame) -> DataFrame:
    """From each pair the column that is closer to the others; ties and missing means drop B.

    A lead below ``TIE`` is summation noise, which differs between runs, and counts as a tie.
    """
    worse = F.when(F.col("corr_a_mean") > F.col("corr_b_mean") + F.lit(TIE), F.col("feat_a")).otherwise(F.col("feat_b"))
    return report.select(worse.alias("feature")).distinct()


def protect_features(drops: DataFrame, ignore_keys: Sequence[str]) -> DataFrame:
    """Take names containing any of the keys off the list."""
    for key in ignore_keys:
        drops = drops.where(~F.col("feature").contains(key))
    return drops


def direct_drop_list(corr: DataFrame, threshold: float) -> DataFrame:
    """The later column of every pair with signed ``r > threshold``."""
    return corr.where(F.col("r") > F.lit(float(threshold))).select(F.col("feat_b").alias("feature")).distinct()


def drop_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.9, method: str = "pearson",
                    mode: str = "pair", ignore_keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The table without correlated columns, and the report of the pairs.

    All pairs are judged on the one matrix. The list of names comes to the driver (there are as
    many as columns) to build the projection.
    """
    if mode not in MODES:
        raise ValueError(f"{mode} is not defined, use one of {MODES}")
    corr = cut(corr_matrix(df, columns, method))  # one row per column pair, used three times
    report = corr_pair_report(corr, threshold)
    drops = drop_list(report) if mode == "pair" else direct_drop_list(corr, threshold)
    names = {r["feature"] for r in protect_features(drops, ignore_keys if mode == "pair" else ()).collect()}
    return df.select(*[col(c) for c in df.columns if c not in names]), report
