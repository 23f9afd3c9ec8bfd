"""Sums of products of columns per group: the one aggregate behind the linear features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fellscape.functions.columns import col

FLUSH = 4_000_000  # cells of partial matrices a task keeps before it writes them out
TREE = (4096, 64)  # groups of each merging round, so that no task stacks the matrices of all tasks
NATIVE = 12  # columns up to which the sums are plain aggregates


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
         expand: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(keys, n, s, g)``: row count, column sums and the flattened matrix of products per group.

    Each task sums its batches as matrix products and hands on one small row per group, so what
    is shuffled does not grow with the rows; hot groups are summed where they lie. ``expand``
    may derive regressors from the columns of a batch.
    """
    keys, columns = list(keys), list(columns)
    if expand is None and len(columns) <= NATIVE:
        return native_gram(df, keys, columns)
    names = [f"_c{k}" for k in range(len(columns))]
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, n long, s array<double>, g array<double>"

    def rows(acc):
        return pd.DataFrame([(*key, n, s, g.ravel()) for key, (n, s, g) in acc.items()], columns=[*keys, "n", "s", "g"])

    def partial(batches):
        acc, cells = {}, 0
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                x = part[names].to_numpy(float)
                x = expand(x) if expand else x
                new = (len(x), x.sum(axis=0), x.T @ x)
                old = acc.get(key)
                if old is None:
                    cells += new[2].size
                acc[key] = new if old is None else tuple(a + b for a, b in zip(old, new))
            if cells > FLUSH:
                yield rows(acc)
                acc, cells = {}, 0
        if acc:
            yield rows(acc)

    slim = df.select(*[col(k) for k in keys], *[col(c).cast("double").alias(a) for c, a in zip(columns, names)])
    return merged(slim.mapInPandas(partial, schema), keys, schema)


def merged(parts: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    """Rows ``(keys, n, s, g)`` of many tasks summed per key, in rounds of bounded groups."""
    keys = list(keys)
    group = [col(k) for k in keys]

    def merge(key, pdf):
        return pd.DataFrame([(*key[:len(keys)], int(pdf["n"].sum()), np.sum(np.stack(pdf["s"]), axis=0),
                              np.sum(np.stack(pdf["g"]), axis=0))], columns=[*keys, "n", "s", "g"])

    def merge_to(groups):
        return lambda key, pdf: merge(key, pdf).assign(_salt=int(key[-1]) % groups)

    parts = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(TREE[0])))
    for groups in TREE[1:]:
        parts = parts.groupBy(*group, "_salt").applyInPandas(merge_to(groups), f"{schema}, _salt int")
    return parts.groupBy(*group, "_salt").applyInPandas(merge, schema).groupBy(*group).applyInPandas(merge, schema)


def native_gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same sums as one hash aggregate: cheaper for few columns, and for many small groups."""
    q = len(columns)
    x = [col(c).cast("double") for c in columns]
    sums = df.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(q)],
        *[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(q) for j in range(i, q)])
    cells = [F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(q) for j in range(q)]
    return sums.select(*[col(k) for k in keys], "n", F.array(*[F.col(f"s{i}") for i in range(q)]).alias("s"), F.array(*cells).alias("g"))


def centred(n, s, g):
    """Means and the matrix of centred products."""
    s = np.asarray(s, dtype=float)
    g = np.asarray(g, dtype=float).reshape(len(s), len(s))
    mean = s / n
    return mean, g - n * np.outer(mean, mean)


def solve(gram_x: np.ndarray, t: np.ndarray) -> np.ndarray | None:
    """Slopes of a regression from centred products; None when the columns are not independent."""
    scale = np.sqrt(np.diag(gram_x))
    if not np.all(scale > 0):
        return None
    r = gram_x / np.outer(scale, scale)
    if np.linalg.matrix_rank(r, hermitian=True, tol=1e-9) < len(r):
        return None
    return np.linalg.solve(r, t / scale) / scale
