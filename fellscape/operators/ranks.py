"""Rank correlations of column pairs over their complete rows: n log n work in strips of bounded size.

Every column is cut at approximate quantiles.  A value that is itself a border has a bucket of its own, so a value that
many rows share never makes a bucket of open width large.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fellscape.functions.columns import col
from fellscape.session import cut

STRIP = 1 << 16  # rows of a bucket
MOST_BORDERS = 1023


def numbered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles ``c0, c1, ...`` with a row number, written once so that it stays the same."""
    cells = [col(c).cast("double") for c in columns]
    return cut(df.select(F.monotonically_increasing_id().alias("_row"), *[F.when(~F.isnan(c), c).alias(f"c{k}") for k, c in enumerate(cells)]))


def borders_of(rows: DataFrame, p: int, strip: int) -> list[np.ndarray]:
    """Ascending borders of each column; a few numbers a column, on the driver."""
    count = min(MOST_BORDERS, math.ceil(rows.count() / strip) - 1)
    if count < 1:
        return [np.empty(0)] * p
    shares = [k / (count + 1) for k in range(1, count + 1)]
    found = rows.agg(*[F.percentile_approx(f"c{k}", shares, 10_000).alias(f"c{k}") for k in range(p)]).first()
    return [np.unique(np.array(found[f"c{k}"] or [], float)) for k in range(p)]


def bucket_of(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Even numbers between borders, odd ones for the borders themselves; ascending with the value."""
    low = np.searchsorted(borders, values, side="left")
    return 2 * low + (np.searchsorted(borders, values, side="right") > low)


def _cells(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return np.column_stack([batch.column(f"c{k}").to_numpy(zero_copy_only=False) for k in range(p)]).astype(float)


def ties(*keys: np.ndarray) -> int:
    """Pairs of rows that agree in all keys."""
    if not len(keys[0]):
        return 0
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    n = np.diff(np.append(np.flatnonzero(np.concatenate(([True], new[1:]))), len(order)))
    return int((n * (n - 1) // 2).sum())


def inversions(ranks: np.ndarray) -> int:
    """Pairs in which the earlier rank is larger: bit by bit from the top, in groups of equal higher bits."""
    total, now = 0, ranks.astype(np.int64)
    index = np.arange(len(now))
    for bit in range(int(now.max(initial=0)).bit_length() - 1, -1, -1):
        group = now >> (bit + 1)
        first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), index, 0))
        one = (now >> bit & 1).astype(bool)
        ones = np.concatenate(([0], np.cumsum(one)))
        before = ones[:-1] - ones[first]  # ones earlier in the group
        total += int(before[~one].sum())
        last = np.searchsorted(first, first, side="right")
        zeros = (last - first) - (ones[last] - ones[first])
        place = np.where(one, first + zeros + before, index - before)
        moved = np.empty_like(now)
        moved[place] = now
        now = moved
    return total


def excess(x: np.ndarray, y: np.ndarray, part: np.ndarray | None = None) -> int:
    """Concordant less discordant pairs; of pairs within a part only, where parts ascend with ``y``."""
    part = np.zeros(len(x), np.int64) if part is None else part
    ranks = np.unique(y, return_inverse=True)[1]
    order = np.lexsort((ranks, x, part))
    return ties(part) - ties(ranks) - 2 * inversions(ranks[order]) - ties(part, x) + ties(x, ranks)


def between_buckets(counts: np.ndarray) -> int:
    """Concordant less discordant pairs of rows in different buckets of both columns, from the counts of a grid."""
    n = counts.astype(object) if counts.sum() > 2 ** 31 else counts.astype(np.int64)
    above = np.zeros_like(n)
    above[1:] = np.cumsum(n, axis=0)[:-1]
    left, right = np.zeros_like(n), np.zeros_like(n)
    left[:, 1:] = np.cumsum(above, axis=1)[:, :-1]
    right[:, :-1] = np.cumsum(above[:, ::-1], axis=1)[:, ::-1][:, 1:]
    return int((n * (left - right)).sum())


def kendall(df: DataFrame, columns: Sequence[str], strip: int = STRIP) -> DataFrame:
    """``i, j, r``: tau-b of each pair of columns.

    Pairs of rows in different buckets of both columns are counted from a grid of counts.  The rest lies in one bucket of the
    first column or of the second, and is counted within these strips; pairs that lie in both were
    counted twice and are taken off.  A strip holds whole rows and serves all partners of its column.
    """
    p = len(columns)
    rows = numbered(df, columns)
    borders = borders_of(rows, p, strip)
    cells = [f"c{k}" for k in range(p)]

    def grid(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            v = _cells(batch, p)
            at = np.column_stack([bucket_of(v[:, k], borders[k]) for k in range(p)])
            known = ~np.isnan(v)
            for i in range(p):
                for j in range(i + 1, p):
                    both = known[:, i] & known[:, j]
                    width = 2 * len(borders[j]) + 1
                    keys, counts = np.unique(at[both, i] * width + at[both, j], return_counts=True)
                    for key, n in zip(keys.tolist(), counts.tolist()):
                        sums[i, j, key // width, key % width] = sums.get((i, j, key // width, key % width), 0) + n
        keys = np.array(list(sums), np.int32).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, k]) for k in range(4)), pa.array(list(sums.values()), pa.int64())], names=["i", "j", "a", "b", "n"])

    counted = rows.mapInArrow(grid, "i int, j int, a int, b int, n long").groupBy("i", "j", "a", "b").agg(F.sum("n").alias("n"))

    def across(key, pdf):
        i, j = int(key[0]), int(key[1])
        n = np.zeros((2 * len(borders[i]) + 1, 2 * len(borders[j]) + 1), np.int64)
        n[pdf["a"], pdf["b"]] = pdf["n"]
        equal = [(m * (m - 1) // 2).sum() for m in (n.sum(axis=1)[1::2], n.sum(axis=0)[1::2])]
        whole = int(n.sum())
        return pd.DataFrame({"i": [i], "j": [j], "c": [between_buckets(n)], "all": [whole * (whole - 1) // 2], "ti": [equal[0]], "tj": [equal[1]]})

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _cells(batch, p)
            for k in range(p):
                at = bucket_of(v[:, k], borders[k])
                keep = np.flatnonzero(~np.isnan(v[:, k]) & (at % 2 == 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), k, np.int32)), pa.array(at[keep].astype(np.int32)),
                                                  *(pa.array(v[keep, m]) for m in range(p))], names=["k", "a", *cells])

    def within(key, pdf):
        k, v, out = int(key[0]), pdf[cells].to_numpy(float), []
        for m in range(p):
            if m == k:
                continue
            own = v[~np.isnan(v[:, m])]
            x, y = own[:, k], own[:, m]
            c, t = excess(x, y), ties(x)
            if k < m:
                c -= excess(x, y, bucket_of(y, borders[m]))
            out.append((min(k, m), max(k, m), c, t if k < m else 0, 0 if k < m else t))
        return pd.DataFrame(out, columns=["i", "j", "c", "ti", "tj"])

    strips = (rows.mapInArrow(dealt, "k int, a int, " + ", ".join(f"{c} double" for c in cells)).groupBy("k", "a")
              .applyInPandas(within, "i int, j int, c long, ti long, tj long"))
    grids = counted.groupBy("i", "j").applyInPandas(across, "i int, j int, c long, all long, ti long, tj long")
    every = grids.unionByName(strips.withColumn("all", F.lit(0).cast("long")))
    sums = every.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("c", "all", "ti", "tj")])
    return sums.select("i", "j", F.try_divide(F.col("c").cast("double"), F.sqrt(F.col("all") - F.col("ti")) * F.sqrt(F.col("all") - F.col("tj"))).alias("r"))


def missing_classes(rows: DataFrame, p: int) -> list[int]:
    """Columns that lack a value in the same rows have one class; numbered from 0."""
    differ = rows.agg(*[F.count_if(F.col(f"c{i}").isNull() != F.col(f"c{j}").isNull()).alias(f"d{i}_{j}") for i in range(p) for j in range(i + 1, p)]).first() if p > 1 else {}
    first = [next((i for i in range(j) if differ[f"d{i}_{j}"] == 0), j) for j in range(p)]
    return [sorted(set(first)).index(k) for k in first]


def mean_ranks(rows: DataFrame, p: int, classes: Sequence[int], strip: int) -> DataFrame:
    """``k, v, ranks``: the mean rank of each value of each column among the rows that have a partner of each class.

    Equal values are counted first, so that a window sees the distinct values of one bucket only.
    """
    borders, kinds = borders_of(rows, p, strip), max(classes) + 1
    partner = [classes.index(c) for c in range(kinds)]

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _cells(batch, p)
            known = ~np.isnan(v)
            for k in range(p):
                own = known[:, k]
                values, at = np.unique(v[own, k] + 0.0, return_inverse=True)
                n = [np.bincount(at, known[own, m], len(values)).astype(np.int64) for m in partner]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(bucket_of(values, borders[k]).astype(np.int32)),
                                                  pa.array(values), *map(pa.array, n)], names=["k", "a", "v", *[f"n{c}" for c in range(kinds)]])

    sizes = [f"n{c}" for c in range(kinds)]
    values = rows.mapInArrow(counted, "k int, a int, v double, " + ", ".join(f"{n} long" for n in sizes)).groupBy("k", "a", "v").agg(*[F.sum(n).alias(n) for n in sizes])
    values = cut(values)
    before = W.partitionBy("k").orderBy("a").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    offsets = values.groupBy("k", "a").agg(*[F.sum(n).alias(n) for n in sizes]).select("k", "a", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o{n}") for n in sizes])
    inside = W.partitionBy("k", "a").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    ranks = [F.col(f"o{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)) + (F.col(n) + 1) / 2.0 for n in sizes]
    return values.join(F.broadcast(offsets), ["k", "a"]).select("k", "v", F.array(*ranks).alias("ranks"))  # at most 2047 buckets a column


def spearman(df: DataFrame, columns: Sequence[str], strip: int = STRIP) -> DataFrame:
    """``i, j, r``: correlation of the mean ranks of each pair's complete rows."""
    p = len(columns)
    rows = numbered(df, columns)
    classes = missing_classes(rows, p)
    ranks = mean_ranks(rows, p, classes, strip)
    long = rows.select("_row", F.posexplode(F.array(*[F.col(f"c{k}") + F.lit(0.0) for k in range(p)])).alias("k", "v")).where("v IS NOT NULL")
    wide = long.join(ranks, ["k", "v"]).groupBy("_row").agg(*[F.max(F.when(F.col("k") == k, F.col("ranks"))).alias(f"r{k}") for k in range(p)])
    left, right = np.triu_indices(p, k=1)
    pairs = [(i, j, classes[j], classes[i]) for i, j in zip(left.tolist(), right.tolist())]
    sizes = rows.agg(*[F.count_if(F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()) for i, j, _, _ in pairs]).first() if pairs else ()
    middle = [(n + 1) / 2 for n in sizes]

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(pairs)))
        kinds = max(classes) + 1
        for batch in batches:
            r = []
            for k in range(p):
                column = batch.column(f"r{k}")
                flat = np.full((batch.num_rows, kinds), np.nan)
                flat[np.asarray(column.is_valid())] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, kinds)
                r.append(flat)
            for m, (i, j, ci, cj) in enumerate(pairs):
                x, y = r[i][:, ci] - middle[m], r[j][:, cj] - middle[m]
                both = ~(np.isnan(x) | np.isnan(y))
                x, y = x[both], y[both]
                sums[:, m] += x @ y, x @ x, y @ y
        yield pa.RecordBatch.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *map(pa.array, sums)], names=["i", "j", "xy", "xx", "yy"])

    sums = wide.mapInArrow(partial, "i int, j int, xy double, xx double, yy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    return sums.select("i", "j", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("r"))
