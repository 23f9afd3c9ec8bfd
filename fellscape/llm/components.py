"""Connected components by alternating stars, on edge tables that stay distributed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fellscape.session import cut


def _nearest(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``, itself included; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them (edges run from larger to smaller)."""
    near = _nearest(edges)
    moved = edges.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(near.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``node, root`` for every node with a link; the root is the smallest node of its component.

    Edges are long columns ``a`` and ``b``; NULLs and self-links are ignored.  Every round is
    written to the shared folder; the number of rounds grows with the logarithm of the longest
    chain.  A hub of any degree is only joined and minimised, never gathered.  ``cut`` writes a round.
    """
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
                .where("_a is not null and _b is not null and u != v").select("u", "v").distinct())
    before = _mark(edges)
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
