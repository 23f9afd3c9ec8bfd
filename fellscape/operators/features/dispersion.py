"""Dispersion features (disp): distances among the best points against distances among all points."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from fellscape.functions.columns import col
from fellscape.operators.features.levels import with_levels
from fellscape.operators.features.neighbours import blocked
from fellscape.operators.rescale import Bounds
from fellscape.operators.tiles import distances, tiled, upper
from fellscape.session import cut, task_count

QUANTILES = (0.02, 0.05, 0.10, 0.25)
BINS = 4096
EXACT = 100_000  # distances left in an interval that are listed by value
ALL = "*"  # the subset of all points, shared by the responses
TILE = 1024
MOST_BLOCKS = 32  # blocks of a tile; a task holds two tiles, whatever the number of points


def bin_of(d: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    return np.clip((bins * ((d - lo) / (hi - lo))).astype(np.int64), 0, bins - 1)


def inside(d: np.ndarray, path, bins: int) -> np.ndarray:
    """Distances that fell into the kept bins of every earlier pass (by the same arithmetic)."""
    for lo, hi, first, last in path:
        at = bin_of(d, lo, hi, bins)
        d = d[(at >= first) & (at <= last)]
    return d


def subset_distances(a: Block, b: Block, same: bool, keys: Sequence[tuple[str, int]]):
    """Distances between two blocks for the wanted subsets ``(label number or ALL, k)``, each pair of blocks computed once."""
    by_label: dict = {}
    for label, k in keys:
        by_label.setdefault(label, []).append(k)
    whole = None
    if ALL in by_label:
        whole = distances(a.x, b.x)
        yield ALL, by_label[ALL][0], whole[upper(whole.shape, same)]
    for label, ks in by_label.items():
        if label == ALL:
            continue
        ra, rb = a.low[label], b.low[label]
        if not len(ra) or not len(rb):
            continue
        some = distances(a.x[ra], b.x[rb]) if whole is None else whole[np.ix_(ra, rb)]
        level = np.maximum(a.level[label][ra][:, None], b.level[label][rb][None, :])
        keep = ra[:, None] < rb[None, :] if same else np.ones(some.shape, dtype=bool)
        for k in ks:
            yield label, k, some[keep & (level <= k)]


class Block:
    """Points of a stretch of the curve with their box; per response the points that a quantile holds."""

    def __init__(self, pdf: pd.DataFrame, x: Sequence[str], n_labels: int, n_quantiles: int):
        self.x = pdf[x].to_numpy(float)
        self.lo, self.hi = self.x.min(axis=0), self.x.max(axis=0)
        self.level = [pdf[f"_l{i}"].to_numpy() for i in range(n_labels)]
        self.low = [np.nonzero(level < n_quantiles)[0] for level in self.level]

    def range_to(self, other: Block) -> tuple[float, float]:
        """Smallest and largest distance that two points of the boxes can have."""
        near = np.maximum(np.maximum(self.lo - other.hi, other.lo - self.hi), 0)
        far = np.maximum(self.hi - other.lo, other.hi - self.lo)
        return math.sqrt(float(near @ near)) * (1 - 1e-12), math.sqrt(float(far @ far)) * (1 + 1e-12)


class PairDistances:
    """Histograms and values of the pair distances of nested subsets, from blocks of rows.

    Distances are computed once per block pair and serve all responses. Subsets are numbered by
    quantile; the subset of all points is shared by the responses under the label ``*``. Blocks lie
    along a space-filling curve; a task compares two tiles of up to ``MOST_BLOCKS`` blocks, fewer where that
    would leave tasks idle, so its memory does not depend on the number of rows, and a row is copied once per tile. A later pass
    opens only block pairs that can have a distance in a bin that is still open; ``opened`` counts them.
    """

    def __init__(self, rows: DataFrame, x: Sequence[str], labels: Sequence[str], n_quantiles: int, n: int):
        self.rows, self.x, self.labels = rows, list(x), list(labels)
        self.nq, self.n = n_quantiles, n
        self.opened = rows.sparkSession.sparkContext.accumulator(0)

    def keys(self, reps: Sequence[int]):
        own = [(label, k) for label in self.labels for k in range(self.nq)]
        return [(r, label, k) for r in reps for label, k in [(ALL, self.nq), *own]]

    def _tiles(self, spans, add, rows_of, columns, types):
        """``add(sum, key, distances)`` over the block pairs whose range meets the key's span; one result per tile pair."""
        x, labels, nq, opened = self.x, self.labels, self.nq, self.opened
        number = {label: i for i, label in enumerate(labels)} | {ALL: ALL}

        def kernel(a, b, same):
            sums: dict = {}
            if len(a) and len(b):
                rep = int(a["rep"].iloc[0])
                own = [(key, number[key[1]]) for key in spans if key[0] == rep]
                left = [Block(part, x, len(labels), nq) for _, part in a.groupby("_block_no")]
                right = left if same else [Block(part, x, len(labels), nq) for _, part in b.groupby("_block_no")]
                for i, p in enumerate(left):
                    for j in range(i if same else 0, len(right)):
                        near, far = p.range_to(right[j])
                        wanted = {(label, key[2]): key for key, label in own if near <= spans[key][1] and far >= spans[key][0]}
                        if not wanted:
                            continue
                        opened.add(1)
                        for label, k, d in subset_distances(p, right[j], same and i == j, list(wanted)):
                            if len(d):
                                key = wanted[label, k]
                                sums[key] = add(sums.get(key), key, d)
            out = [rows_of(key, total) for key, total in sums.items() if total is not None]
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=columns)

        rows = self.rows.withColumnRenamed("_block", "_block_no")
        blocks = self.rows.agg(F.max("_block")).first()[0] or 0
        per_tile = max(1, min(MOST_BLOCKS, math.ceil((blocks + 1) / math.sqrt(8 * task_count(self.rows.sparkSession)))))
        return tiled(rows, ["rep"], "id", (blocks // per_tile + 1) * per_tile, kernel, f"rep int, {types}", per_tile,
                     F.floor(F.col("_block_no") / per_tile).cast("int"))

    def histogram(self, paths: dict, spans: dict) -> DataFrame:
        """``(rep, label, k, bin, c, s)`` over the current span of each subset."""
        bins = BINS

        def add(total, key, d):
            d = inside(d, paths[key], bins)
            if not len(d):
                return total
            at = bin_of(d, *spans[key], bins)
            c, s = np.bincount(at, minlength=bins), np.bincount(at, weights=d, minlength=bins)
            return (c, s) if total is None else (total[0] + c, total[1] + s)

        def rows_of(key, total):
            used = np.nonzero(total[0])[0]
            return pd.DataFrame({"label": key[1], "k": key[2], "bin": used, "c": total[0][used], "s": total[1][used]})

        parts = self._tiles(spans, add, rows_of, ["label", "k", "bin", "c", "s"], "label string, k int, bin int, c long, s double")
        return parts.groupBy("rep", "label", "k", "bin").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))

    def values(self, paths: dict) -> DataFrame:
        """``(rep, label, k, v, c)``: the distinct distances left in each subset."""
        bins = BINS

        def add(total, key, d):
            d = inside(d, paths[key], bins)
            return total if not len(d) else d if total is None else np.concatenate((total, d))

        def rows_of(key, total):
            v, c = np.unique(total, return_counts=True)
            return pd.DataFrame({"label": key[1], "k": key[2], "v": v, "c": c})

        spans = {}
        for key, path in paths.items():
            lo, hi, first, last = path[-1]
            step = (hi - lo) / BINS  # a bin more at either end, for rounding
            spans[key] = (lo + (first - 1) * step, lo + (last + 2) * step)
        parts = self._tiles(spans, add, rows_of, ["label", "k", "v", "c"], "label string, k int, v double, c long")
        return parts.groupBy("rep", "label", "k", "v").agg(F.sum("c").alias("c"))


def subset_statistics(pairs: PairDistances, reps: Sequence[int], longest: float, spark) -> DataFrame:
    """``(rep, label, k, mean, median)`` of every subset with at least one pair, exact.

    The first pass over the blocks gives counts, sums and a histogram. The bins holding the
    middle ranks are then cut again until few enough distances are left to list them by value.
    One row per subset is read on the driver after each pass.
    """
    paths = {key: [] for key in pairs.keys(reps)}
    spans = {key: (0.0, longest) for key in paths}
    ranks: dict = {}
    means: dict = {}
    by = W.partitionBy("rep", "label", "k")
    while spans:
        hist = pairs.histogram(paths, spans)
        if ranks:
            hist = hist.join(F.broadcast(spark.createDataFrame(
                [(*key, *ranks[key]) for key in spans], "rep int, label string, k int, r0 long, r1 long")), ["rep", "label", "k"])
        else:
            whole = F.sum("c").over(by)
            hist = hist.withColumn("r0", F.floor((whole - 1) / 2)).withColumn("r1", F.floor(whole / 2))
        cum = F.sum("c").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        rows = hist.withColumn("cum", cum).groupBy("rep", "label", "k").agg(
            F.sum("c").alias("n"), F.sum("s").alias("s"), F.first("r0").alias("r0"), F.first("r1").alias("r1"),
            F.min(F.when(F.col("cum") > F.col("r0"), F.col("bin"))).alias("first"),
            F.min(F.when(F.col("cum") > F.col("r1"), F.col("bin"))).alias("last"),
            F.coalesce(F.max(F.when(F.col("cum") <= F.col("r0"), F.col("cum"))), F.lit(0)).alias("skipped"),
            F.min(F.when(F.col("cum") > F.col("r1"), F.col("cum"))).alias("upto")).collect()
        later = {}
        for row in rows:
            key = (row["rep"], row["label"], row["k"])
            means.setdefault(key, row["s"] / row["n"])
            lo, hi = spans[key]
            step = (hi - lo) / BINS
            paths[key] = [*paths[key], (lo, hi, row["first"], row["last"])]
            ranks[key] = (int(row["r0"]) - row["skipped"], int(row["r1"]) - row["skipped"])
            span = (lo + row["first"] * step, lo + (row["last"] + 1) * step)
            if row["upto"] - row["skipped"] > EXACT and span[1] - span[0] > 1e-9 * longest:
                later[key] = span
        spans = later
    values = pairs.values({key: paths[key] for key in means})
    small = spark.createDataFrame([(*key, *ranks[key], means[key]) for key in means],
                                  "rep int, label string, k int, r0 long, r1 long, mean double")
    cum = F.sum("c").over(by.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    at = lambda r: F.min(F.when(F.col("cum") > F.col(r), F.col("v")))
    return (values.withColumn("cum", cum).join(F.broadcast(small), ["rep", "label", "k"])
            .groupBy("rep", "label", "k").agg(F.first("mean").alias("mean"), ((at("r0") + at("r1")) / 2).alias("median")))


def dispersion_features(points: DataFrame, x: Sequence[str], labels: Sequence[str], bounds: Bounds, n: int,
                        reps: Sequence[int], id_col: str = "sample_id", quantiles: Sequence[float] = QUANTILES,
                        bound: int | None = None) -> DataFrame:
    """``disp.ratio_*`` and ``disp.diff_*`` of every response and quantile, mean and median."""
    xs, ys = [f"_x{j}" for j in range(len(x))], [f"_y{k}" for k in range(len(labels))]
    slim = points.select("rep", col(id_col), *[col(c).alias(a) for c, a in zip([*x, *labels], [*xs, *ys])])
    leveled = blocked(with_levels(slim, ys, quantiles, bound, lambda y, q: y <= q).drop(*ys).withColumnRenamed(id_col, "id"), xs, TILE)
    longest = math.sqrt(sum((hi - lo) ** 2 for lo, hi in zip(bounds.lower, bounds.upper))) * (1 + 1e-9)
    pairs = PairDistances(leveled, xs, labels, len(quantiles), n)
    stats = cut(subset_statistics(pairs, reps, longest, points.sparkSession))
    whole = stats.where(F.col("label") == ALL).select("rep", F.col("mean").alias("mean_all"), F.col("median").alias("median_all"))
    own = stats.where(F.col("label") != ALL).join(F.broadcast(whole), "rep")  # one row per repeat
    tags = F.array(*[F.lit(f"{round(100 * q):02d}") for q in quantiles])
    cells = F.array(*[F.struct(F.concat(F.lit(f"disp.{how}_{what}_"), F.get(tags, F.col("k"))).alias("feature"), value.alias("value"))
                      for what in ("mean", "median") for how, value in (
                          ("ratio", F.try_divide(F.col(what), F.col(f"{what}_all"))), ("diff", F.col(what) - F.col(f"{what}_all")))])
    return own.select("rep", "label", F.explode(cells).alias("f")).select("rep", "label", "f.feature", "f.value")
