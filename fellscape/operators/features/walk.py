"""Information content (ic) of a seeded random walk over the points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from fellscape.functions.columns import col, key_hash
from fellscape.operators.position import hex_bucket, hex_digits, position_in_buckets
from fellscape.operators.tables import to_long
from fellscape.session import task_count

SEED = 100  # fixed value: seed of the walk
SETTLED = 0.05
BLOCK = 16_384  # walk steps per task
EPS = np.concatenate([[0.0], 10.0 ** (-5.0 + 20.0 * np.arange(1000) / 999.0)])
SYMBOLS = [(1, -1), (-1, 1), (1, 0), (-1, 0), (0, 1), (0, -1)]


def walk_positions(points: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """The place of each point on the walk: the rank of its seeded hash, per repeat."""
    h = key_hash(seed, col(id_col))
    source = points.select("rep", col(id_col))
    return position_in_buckets(points, hex_bucket(h, hex_digits(n)), [h, col(id_col)], "pos", ["rep"], source)


def symbol_changes(sign: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sign, last sign and number of sign changes of the non-zero symbols, per threshold.

    ``known`` is the number of thresholds a slope exceeds, so it is non-zero at the thresholds
    below that number.
    """
    size = len(EPS)
    first, last, changes = (np.zeros(size, dtype=np.int64) for _ in range(3))
    index, start = np.nonzero(known > 0)[0], 0
    for stop in [*np.unique(known[known > 0])]:
        s = sign[index]
        first[start:stop], last[start:stop], changes[start:stop] = s[0], s[-1], np.count_nonzero(s[1:] != s[:-1])
        index, start = index[known[index] > stop], stop
    return first, last, changes


def pair_counts(sign: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Per threshold, how often each pair of unequal symbols follows one another.

    A pair of slopes has one pair of symbols up to the smaller of the two, another up to the
    larger and two zeros beyond: three ranges, counted by their ends.
    """
    size = len(EPS)
    a, b, ka, kb = sign[:-1], sign[1:], known[:-1], known[1:]
    out = np.zeros((len(SYMBOLS), size + 1), dtype=np.int64)
    for row, (left, right) in zip(out, SYMBOLS):
        if left and right:
            hit = (a == left) & (b == right)
            lo, hi = np.zeros(hit.sum(), dtype=np.int64), np.minimum(ka, kb)[hit]
        elif left:
            hit = (a == left) & (ka > kb)
            lo, hi = kb[hit], ka[hit]
        else:
            hit = (b == right) & (kb > ka)
            lo, hi = ka[hit], kb[hit]
        row += np.bincount(lo, minlength=size + 1) - np.bincount(hi, minlength=size + 1)
    return np.cumsum(out, axis=1)[:, :size]


def block_summaries(placed: DataFrame, x: Sequence[str], labels: Sequence[str], n: int) -> DataFrame:
    """``(rep, label, block, e, ...)``: symbol counts of a stretch of the walk, per threshold.

    Each block also gets the next two points, so that no step or pair of steps falls between blocks.
    A block with a step of length zero or a missing response says so in ``bad``; one such step leaves
    the response without a walk.
    """
    labels, xs = list(labels), [f"_x{j}" for j in range(len(x))]
    block = F.floor(F.col("pos") / BLOCK).cast("int")
    both = F.when((F.col("pos") % BLOCK < 2) & (F.col("pos") >= BLOCK), F.array(block, block - 1)).otherwise(F.array(block))
    rows = placed.select("rep", "pos", *[col(c).alias(a) for c, a in zip(x, xs)],
                         *[col(c).alias(f"_y{k}") for k, c in enumerate(labels)], F.explode(both).alias("block"))
    schema = ("rep int, label string, block int, e int, first int, last int, changes long, steps long, bad int, "
              + ", ".join(f"p{k} long" for k in range(len(SYMBOLS))))

    def summarise(key, pdf):
        rep, block = key
        pdf = pdf.sort_values("pos")
        own = int((pdf["pos"] < (block + 1) * BLOCK).sum())
        gap = np.diff(pdf[xs].to_numpy(float), axis=0)
        length = np.sqrt((gap * gap).sum(axis=1))
        steps = min(own, len(pdf) - 1)
        out = []
        for k, label in enumerate(labels):
            if steps < 1:
                break
            r = np.diff(pdf[f"_y{k}"].to_numpy(float)) / length
            if not np.all(np.isfinite(r)):
                out.append(pd.DataFrame({"rep": rep, "label": label, "block": block, "e": [0], "first": 0, "last": 0, "changes": 0,
                                         "steps": 0, "bad": 1, **{f"p{i}": 0 for i in range(len(SYMBOLS))}}))
                continue
            sign, known = np.sign(r).astype(np.int64), np.searchsorted(EPS, np.abs(r), side="left")
            first, last, changes = symbol_changes(sign[:steps], known[:steps])
            pairs = pair_counts(sign[:steps + 1], known[:steps + 1])
            out.append(pd.DataFrame({"rep": rep, "label": label, "block": block, "e": np.arange(len(EPS)), "first": first,
                                     "last": last, "changes": changes, "steps": steps, "bad": 0,
                                     **{f"p{i}": pairs[i] for i in range(len(SYMBOLS))}}))
        names = [f.split()[0] for f in schema.split(", ")]
        return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame(columns=names)

    tasks = min(max(1, n // BLOCK + 1) * 2, 4 * task_count(placed.sparkSession))
    return rows.repartition(tasks, "rep", "block").groupBy("rep", "block").applyInPandas(summarise, schema)


def threshold_curves(blocks: DataFrame) -> DataFrame:
    """``(rep, label, e, eps, h, m)``: entropy and partial information at every threshold."""
    along = W.partitionBy("rep", "label", "e").orderBy("block")
    known = F.when(F.col("last") != 0, F.col("last"))
    before = F.last(known, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    joint = F.when((F.col("first") != 0) & before.isNotNull() & (before != F.col("first")), 1).otherwise(0)
    sums = blocks.withColumn("_joint", joint).groupBy("rep", "label", "e").agg(
        F.sum("steps").alias("steps"), F.sum(F.col("changes") + F.col("_joint")).alias("changes"),
        F.max(F.abs("first")).alias("any"), F.max("bad").alias("bad"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(len(SYMBOLS))])
    terms = []
    for k in range(len(SYMBOLS)):
        p = F.try_divide(F.col(f"p{k}"), F.col("steps") - 1)  # NULL where bad blocks left nothing
        terms.append(F.when(p > 0, -p * F.ln(p) / float(np.log(6))).otherwise(0.0))
    h = terms[0]
    for t in terms[1:]:
        h = h + t
    eps = F.get(F.array(*[F.lit(float(v)) for v in EPS]), F.col("e"))
    return sums.select("rep", "label", "e", eps.alias("eps"), h.alias("h"),
                       F.try_divide(F.col("changes") + F.col("any"), F.col("steps")).alias("m"), "bad")


def walk_features(points: DataFrame, x: Sequence[str], labels: Sequence[str], n: int, id_col: str = "sample_id",
                  seed: int = SEED) -> DataFrame:
    """``ic.*`` of every response. The walk is shared by the responses: it depends on ids only.

    A response with a missing value, or a walk with a step of length zero, has NULL features.
    """
    slim = points.select("rep", col(id_col), *[col(c) for c in x], *[col(c) for c in labels])
    curves = threshold_curves(block_summaries(walk_positions(slim, id_col, n, seed), x, labels, n))
    top = F.round("h", 12)
    first = curves.groupBy("rep", "label").agg(
        F.max("h").alias("ic.h_max"), F.min_by("eps", F.struct(-top, F.col("e"))).alias("ic.eps_max"),
        F.min(F.when((F.col("h") < SETTLED) & (F.col("e") > 0), F.col("eps"))).alias("_s"),
        F.max(F.when((F.col("h") < SETTLED) & (F.col("e") == 0), 1)).alias("_flat"),
        F.max(F.when(F.col("e") == 0, F.col("m"))).alias("ic.m0"), F.max("bad").alias("_bad"),
        F.collect_list(F.struct("e", "eps", "m")).alias("_curve"))  # one entry per threshold
    half = F.filter("_curve", lambda c: (c["m"] > 0.5 * F.col("`ic.m0`")) & (c["e"] > 0))
    wide = first.withColumn("ic.eps_s", F.when(F.col("_flat").isNull(), F.log10("_s"))).withColumn(
        "ic.eps_ratio", F.log10(F.array_max(F.transform(half, lambda c: c["eps"]))))
    names = ["ic.h_max", "ic.eps_s", "ic.eps_max", "ic.m0", "ic.eps_ratio"]
    whole = F.col("_bad") == 0
    return to_long(wide.select("rep", "label", *[F.when(whole, col(c)).alias(c) for c in names]), names, "feature", "value").select(
        "rep", "label", "feature", "value")
