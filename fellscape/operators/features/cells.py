"""Cell-wise linear models (limo): the domain is cut into cells, each with its own slopes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fellscape.functions.columns import col
from fellscape.operators.features import ROWS
from fellscape.operators.features.gram import centred, gram, solve
from fellscape.operators.rescale import Bounds


def cell_number(x: Sequence[str], bounds: Bounds, blocks: int) -> Column:
    """The block numbers of a cell as one text, for any number of inputs; the upper border belongs to the last block."""
    numbers = [F.greatest(F.lit(0), F.least(F.lit(blocks - 1), F.floor((col(name) - F.lit(lo)) / F.lit(hi - lo) * blocks)))
               for name, lo, hi in zip(x, bounds.lower, bounds.upper)]
    return F.concat_ws(",", *[n.cast("string") for n in numbers])


def cell_slopes(points: DataFrame, x: Sequence[str], labels: Sequence[str], bounds: Bounds, blocks: int = 2) -> DataFrame:
    """``(rep, cell, label, b)``: slopes of every cell with at least d + 2 points."""
    d, labels = len(x), list(labels)
    celled = points.withColumn("cell", cell_number(x, bounds, blocks))

    def slopes(batches):
        for pdf in batches:
            out = []
            for rep, cell, n, s, g in pdf[["rep", "cell", "n", "s", "g"]].itertuples(index=False):
                if n < d + 2:
                    continue
                _, c = centred(n, s, g)
                for k, label in enumerate(labels):
                    b = solve(c[:d, :d], c[:d, d + k])
                    if b is not None and np.all(np.isfinite(b)):
                        out.append((rep, cell, label, b))
            yield pd.DataFrame(out, columns=["rep", "cell", "label", "b"])

    return gram(celled, ["rep", "cell"], [*x, *labels]).mapInPandas(
        slopes, "rep int, cell string, label string, b array<double>")


def _standard(vectors: str, d: int) -> Column:
    """A vector centred and scaled to length one, so that products are correlations.

    The mean over all pairs of a product is ``(|sum|**2 - sum |z|**2) / (m (m - 1))``, so no
    pair of cells is ever formed.
    """
    parts = [F.get(vectors, F.lit(j)) for j in range(d)]
    mean = sum(parts[1:], parts[0]) / d
    norm = F.sqrt(sum([(p - mean) ** 2 for p in parts[1:]], (parts[0] - mean) ** 2))
    return F.array(*[F.try_divide(p - mean, norm) for p in parts])


def limo_features(points: DataFrame, x: Sequence[str], labels: Sequence[str], bounds: Bounds, blocks: int = 2) -> DataFrame:
    """``limo.*`` features of all responses; cells are aggregated natively, one row per cell and response."""
    d = len(x)
    b = cell_slopes(points, x, labels, bounds, blocks)
    parts = [F.get("b", F.lit(j)) for j in range(d)]
    length = F.sqrt(sum([p * p for p in parts[1:]], parts[0] * parts[0]))
    b = b.withColumn("len", length).withColumn("u", F.transform("b", lambda v: F.try_divide(v, F.col("len"))))
    size = F.transform("b", lambda v: F.abs(v))
    b = b.withColumn("ratio", F.try_divide(F.array_max(size), F.array_min(size)))
    b = b.withColumn("zb", _standard("b", d)).withColumn("zu", _standard("u", d))

    def each(vec, fn, name):
        return [fn(F.get(vec, F.lit(j))).alias(f"{name}{j}") for j in range(d)]

    aggs = [F.avg("len").alias("len_mean"), F.stddev_samp("len").alias("len_sd"),
            F.avg("ratio").alias("ratio_mean"), F.stddev_samp("ratio").alias("ratio_sd"),
            F.count(F.get("zb", F.lit(0))).alias("m_b"), F.count(F.get("zu", F.lit(0))).alias("m_u")]
    for vec in ("b", "u"):
        aggs += each(vec, F.avg, f"mean_{vec}") + each(vec, F.stddev_samp, f"sd_{vec}") + each(f"z{vec}", F.sum, f"z_{vec}")
    row = b.groupBy("rep", "label").agg(*aggs)

    def names(prefix):
        return [F.col(f"{prefix}{j}") for j in range(d)]

    def norm2(cols):
        return sum([c * c for c in cols[1:]], cols[0] * cols[0])

    values = {"length_mean": F.col("len_mean"), "length_sd": F.col("len_sd"),
              "ratio_mean": F.col("ratio_mean"), "ratio_sd": F.col("ratio_sd")}
    for vec, how in (("b", "reg"), ("u", "norm")):
        m, sds = F.col(f"m_{vec}"), names(f"sd_{vec}")
        values[f"avg_length_{how}"] = F.sqrt(norm2(names(f"mean_{vec}")))
        values[f"cor_{how}"] = F.try_divide(norm2(names(f"z_{vec}")) - m, m * (m - 1))
        top, low = (F.greatest(*sds), F.least(*sds)) if d > 1 else (sds[0], sds[0])
        values[f"sd_ratio_{how}"] = F.try_divide(top, low)
        values[f"sd_mean_{how}"] = sum(sds[1:], sds[0]) / d
    cells = F.array(*[F.struct(F.lit(f"limo.{k}").alias("feature"), v.cast("double").alias("value")) for k, v in values.items()])
    return row.select("rep", "label", F.explode(cells).alias("f")).select("rep", "label", "f.feature", "f.value")


LIMO = ["avg_length_reg", "avg_length_norm", "length_mean", "length_sd", "cor_reg", "cor_norm", "ratio_mean", "ratio_sd",
        "sd_ratio_reg", "sd_ratio_norm", "sd_mean_reg", "sd_mean_norm"]
