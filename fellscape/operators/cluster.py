"""Ward clustering of functions by their features, and flat clusters below a threshold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from fellscape.functions.columns import col
from fellscape.operators.tiles import distances
from fellscape.session import cut


TILE = 1024
#: With this many clusters left the rest of the tree is built in one task.
FEW = 1024
MERGES = "round int, leaf_a long, leaf_b long, height double, size long"


def ward_heights(sizes_a: np.ndarray, centres_a: np.ndarray, sizes_b: np.ndarray, centres_b: np.ndarray) -> np.ndarray:
    na, nb = sizes_a.astype(float)[:, None], sizes_b.astype(float)[None, :]
    return np.sqrt(2 * na * nb / (na + nb)) * distances(centres_a, centres_b)


def _nearest(queries: DataFrame, clusters: DataFrame, n_queries: int, n: int) -> DataFrame:
    """``(leaf, other, height)``: the cluster each queried cluster would merge with at the least height.

    Blocks of queries meet blocks of clusters; every query gets one candidate per block. Ties go to the smaller leaf.
    """
    asked, held = max(1, -(-n_queries // TILE)), max(1, -(-n // TILE))
    block = lambda count: F.pmod(F.xxhash64("leaf"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("leaf", "size", "centre", block(asked).alias("_q"), every(held).alias("_c"))
    right = clusters.select("leaf", "size", "centre", every(asked).alias("_q"), block(held).alias("_c"))

    def kernel(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"leaf": [], "other": [], "height": []})
        b = b.sort_values("leaf")
        h = ward_heights(a["size"].to_numpy(), np.stack(a["centre"]), b["size"].to_numpy(), np.stack(b["centre"]))
        h[a["leaf"].to_numpy()[:, None] == b["leaf"].to_numpy()[None, :]] = np.inf
        at = h.argmin(axis=1)
        return pd.DataFrame({"leaf": a["leaf"].to_numpy(), "other": b["leaf"].to_numpy()[at], "height": h[np.arange(len(a)), at]})

    found = left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInPandas(kernel, "leaf long, other long, height double")
    return (found.where(F.col("height") < float("inf")).groupBy("leaf")
            .agg(F.min(F.struct("height", "other")).alias("b")).select("leaf", F.col("b.other").alias("other"), F.col("b.height").alias("height")))


def _rest(clusters: DataFrame, start: int) -> DataFrame:
    """The merges of at most ``FEW`` clusters, round by round in one task."""
    def run(key, pdf):
        pdf = pdf.sort_values("leaf")
        leaf, size, centre, out, done = pdf["leaf"].to_numpy(), pdf["size"].to_numpy(), np.stack(pdf["centre"]).astype(float), [], start
        while len(leaf) > 1:
            h = ward_heights(size, centre, size, centre)
            np.fill_diagonal(h, np.inf)
            other = h.argmin(axis=1)
            a = np.flatnonzero((other[other] == np.arange(len(leaf))) & (np.arange(len(leaf)) < other))
            b, height = other[a], h[a, other[a]]
            total = size[a] + size[b]
            centre[a] = (centre[a] * size[a][:, None] + centre[b] * size[b][:, None]) / total[:, None]
            size[a] = total
            out.append(pd.DataFrame({"round": done, "leaf_a": leaf[a], "leaf_b": leaf[b], "height": height, "size": total}))
            stays = np.setdiff1d(np.arange(len(leaf)), b)
            leaf, size, centre, done = leaf[stays], size[stays], centre[stays], done + 1
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["round", "leaf_a", "leaf_b", "height", "size"])

    return clusters.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, MERGES)


def ward_rounds(df: DataFrame, columns: Sequence[str], leaf: str) -> DataFrame:
    """``(round, leaf_a, leaf_b, height, size)``: all mutual nearest pairs merge in each round.

    Ward heights never fall below those of the parts, so merging every mutual pair at once gives the same tree as one merge
    at a time, and a cluster keeps its nearest other one until either merges: a round searches for the merged clusters and
    for those that lost theirs. A cluster is named by its smallest leaf.
    """
    clusters = cut(df.select(col(leaf).cast("long").alias("leaf"), F.lit(1).cast("long").alias("size"),
                             F.array(*[col(c).cast("double") for c in columns]).alias("centre")))
    n, d, done, merges, kept = clusters.count(), len(columns), 0, None, None
    if n < 2:
        raise ValueError("clustering needs at least two rows")
    while n > FEW:
        lost = clusters if kept is None else clusters.join(kept.select("leaf"), "leaf", "left_anti")
        lost = cut(lost)
        found = _nearest(lost, clusters, lost.count(), n)
        best = cut(found if kept is None else kept.unionByName(found))
        mutual = (best.groupBy(F.least("leaf", "other").alias("leaf_a"), F.greatest("leaf", "other").alias("leaf_b"))
                  .agg(F.count(F.lit(1)).alias("votes"), F.max("height").alias("height")).where("votes = 2").drop("votes"))
        mutual = cut(mutual)
        merged = mutual.count()
        if not merged:  # ties that were kept in a circle: search anew, where they go to the smaller leaf
            kept = None
            continue
        named = clusters.join(mutual.select(F.col("leaf_b").alias("leaf"), F.col("leaf_a").alias("into")), "leaf", "left").withColumn("into", F.coalesce("into", "leaf"))
        joined = named.groupBy("into").agg(F.sum("size").alias("total"), *[F.sum(F.get("centre", F.lit(j)) * F.col("size")).alias(f"s{j}") for j in range(d)])
        clusters = cut(joined.select(F.col("into").alias("leaf"), F.col("total").alias("size"), F.array(*[F.col(f"s{j}") / F.col("total") for j in range(d)]).alias("centre")))
        gone = mutual.select(F.explode(F.array("leaf_a", "leaf_b")).alias("leaf"))
        kept = cut(best.join(gone, "leaf", "left_anti").join(gone.withColumnRenamed("leaf", "other"), "other", "left_anti").select("leaf", "other", "height"))
        new = mutual.join(clusters.select(F.col("leaf").alias("leaf_a"), "size"), "leaf_a").select(F.lit(done).alias("round"), "leaf_a", "leaf_b", "height", "size")
        merges = new if merges is None else merges.unionAll(new)
        n, done = n - merged, done + 1
    rest = _rest(clusters, done)
    return cut(rest if merges is None else merges.unionAll(rest))


def ward_linkage(df: DataFrame, columns: Sequence[str], leaf: str) -> DataFrame:
    """``(step, left_id, right_id, height, size)`` with leaves 0..m-1 and cluster ``m + step`` for each merge."""
    rounds = ward_rounds(df, columns, leaf)
    m = df.count()
    order = W.partitionBy(F.lit(0)).orderBy("height", "round", "leaf_a")  # one row per merge: functions, not samples
    steps = cut(rounds.withColumn("step", F.row_number().over(order) - 1))
    made = steps.select(F.col("leaf_a").alias("leaf"), F.col("step").alias("made"))

    def side(name):
        """The latest cluster of that name made before the step, else the leaf itself."""
        return (steps.select("step", F.col(f"leaf_{name}").alias("leaf")).join(made, "leaf", "left")
                .groupBy("step", "leaf").agg(F.max(F.when(F.col("made") < F.col("step"), F.col("made"))).alias("made"))
                .select("step", F.coalesce(F.col("made") + m, F.col("leaf")).alias(f"id_{name}")))

    both = steps.join(side("a"), "step").join(side("b"), "step")
    return both.select("step", F.least("id_a", "id_b").alias("left_id"), F.greatest("id_a", "id_b").alias("right_id"), "height", "size")


def cut_clusters(leaves: DataFrame, rounds: DataFrame, threshold: float, leaf: str) -> DataFrame:
    """``leaves`` with ``cluster``: the smallest leaf reached through merges below the threshold.

    A leaf is absorbed at most once, so merges are parent links; following them to the root by
    doubling takes a logarithmic number of joins.
    """
    links = cut(leaves.select(col(leaf).cast("long").alias("leaf")).join(
        rounds.where(F.col("height") < F.lit(float(threshold))).select(F.col("leaf_b").alias("leaf"), F.col("leaf_a").alias("up")),
        "leaf", "left").select("leaf", F.coalesce("up", "leaf").alias("up")))
    while True:
        doubled = cut(links.join(links.select(F.col("leaf").alias("up"), F.col("up").alias("top")), "up")
                      .select("leaf", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        links = doubled.select("leaf", "up")
        if doubled.where("moved").limit(1).count() == 0:
            break
    return leaves.join(links.select(F.col("leaf").alias(leaf), F.col("up").alias("cluster")), leaf)
