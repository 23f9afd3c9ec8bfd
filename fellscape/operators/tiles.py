"""Exact work over all pairs of rows in bounded blocks.

Rows are hashed into blocks of about ``tile`` rows and every pair of blocks becomes one group, so
a task holds two blocks and returns partial results; pairs of rows are never written as rows
unless the kernel itself returns them. One block pair costs the same however the keys are spread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fellscape.functions.columns import col
from fellscape.session import task_count

Kernel = Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]


def tiled(df: DataFrame, keys: Sequence[str], id_col: str, n: int, kernel: Kernel, schema: str,
          tile: int = 2048, block: Column | None = None) -> DataFrame:
    """Apply ``kernel(left, right, same_block)`` to every pair of blocks of each group.

    ``n`` is the row count of the largest group; ``schema`` names the key columns first. Rows are hashed
    into blocks unless ``block`` numbers them, from 0 to below ``n / tile``.
    """
    blocks = max(1, math.ceil(n / tile))
    block = F.pmod(F.xxhash64(col(id_col)), F.lit(blocks)).cast("int") if block is None else block
    copies = (df.withColumn("_block", block)
              .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
              .withColumn("_left", F.least("_block", "_other")).withColumn("_right", F.greatest("_block", "_other"))
              .drop("_other"))
    n_keys = len(keys)

    def run(key, pdf):
        left, right = key[n_keys], key[n_keys + 1]
        a = pdf[pdf["_block"] == left]
        b = a if left == right else pdf[pdf["_block"] == right]
        out = kernel(a, b, left == right)
        for i in range(n_keys - 1, -1, -1):
            out.insert(0, keys[i], key[i])
        return out

    group = [*[col(k) for k in keys], "_left", "_right"]
    tasks = min(blocks * (blocks + 1) // 2, 4 * task_count(df.sparkSession))
    return copies.repartition(tasks, *group).groupBy(*group).applyInPandas(run, schema)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences: exact zeros stay zero."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j][:, None] - b[:, j][None, :]
        out += d * d
    return np.sqrt(out)


def upper(shape: tuple[int, int], same: bool) -> np.ndarray:
    """Mask of the unordered pairs of two blocks."""
    return np.triu(np.ones(shape, dtype=bool), k=1) if same else np.ones(shape, dtype=bool)


def pairwise_distance(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """The distance matrix as ``(id_a, id_b, dist)`` with ``id_a < id_b``.

    Meant for one row per function, where the matrix itself is the result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [f"_c{k}" for k in range(len(columns))]

    def kernel(a, b, same):
        d = distances(a[names].to_numpy(float), b[names].to_numpy(float))
        i, j = np.nonzero(upper(d.shape, same))
        ia, ib = a[id_col].to_numpy()[i], b[id_col].to_numpy()[j]
        swap = ia > ib
        return pd.DataFrame({"id_a": np.where(swap, ib, ia), "id_b": np.where(swap, ia, ib), "dist": d[i, j]})

    slim = df.select(col(id_col), *[col(c).alias(n) for c, n in zip(columns, names)])
    return tiled(slim, [], id_col, slim.count(), kernel, f"id_a {kind}, id_b {kind}, dist double")


def mean_distance(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Mean of the pairwise distances that are not zero; blocks return their sum and count."""
    names = [f"_c{k}" for k in range(len(columns))]

    def kernel(a, b, same):
        d = distances(a[names].to_numpy(float), b[names].to_numpy(float))[
            upper((len(a), len(b)), same)]
        d = d[d > 0]
        return pd.DataFrame({"s": [d.sum()], "n": [len(d)]})

    slim = df.select(col(id_col), *[col(c).alias(n) for c, n in zip(columns, names)])
    parts = tiled(slim, [], id_col, slim.count(), kernel, "s double, n long")
    return parts.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean_dist"), F.sum("n").alias("n_pairs"))
