"""Nearest-better features (nbc): each point's nearest neighbour and nearest neighbour with a smaller response."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fellscape.functions.columns import col
from fellscape.operators.position import position_in_buckets
from fellscape.operators.tables import to_long
from fellscape.operators.tiles import distances
from fellscape.session import cut

TILE = 1024  # points of a block
FAN = 32  # boxes of one level that share a box of the level above
STRIP = 512  # boxes that the points of a block are compared with at a time
AXES = 6  # leading inputs that the curve follows
ROWS_PER_BUCKET = 100_000
SLACK = 1e-12  # rounding of a box distance


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL when either side is constant."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def nbc_features(points: DataFrame, x: Sequence[str], labels: Sequence[str], n: int, id_col: str = "sample_id",
                 found: DataFrame | None = None) -> DataFrame:
    """``nbc.*`` of every response; points without a better one are left out of the ``nb`` statistics."""
    found = found if found is not None else cut(neighbour_search(points, x, labels, n, id_col))
    ratio = F.try_divide(F.col("nn"), F.col("nb"))
    shape = found.groupBy("rep", "label").agg(
        F.try_divide(F.stddev_samp("nn"), F.stddev_samp("nb")).alias("nbc.nn_nb.sd_ratio"),
        F.try_divide(F.avg("nn"), F.avg("nb")).alias("nbc.nn_nb.mean_ratio"),
        correlation("nn", "nb").alias("nbc.nn_nb.cor"),
        F.try_divide(F.stddev_samp(ratio), F.avg(ratio)).alias("nbc.dist_ratio.coeff_var"))
    degree = (found.where("nb_id IS NOT NULL").groupBy("rep", "label", F.col("nb_id").alias(id_col))
              .agg(F.count(F.lit(1)).alias("degree")))
    rows = to_long(points.select("rep", col(id_col), *[col(c) for c in labels]), labels)
    fitness = (rows.join(degree, ["rep", "label", id_col], "left")
               .groupBy("rep", "label").agg(correlation(F.coalesce("degree", F.lit(0)).cast("double"), "y").alias("nbc.nb_fitness.cor")))
    names = ["nbc.nn_nb.sd_ratio", "nbc.nn_nb.mean_ratio", "nbc.nn_nb.cor", "nbc.dist_ratio.coeff_var", "nbc.nb_fitness.cor"]
    return (to_long(shape.join(fitness, ["rep", "label"]), names, "feature", "value")
            .select("rep", "label", "feature", "value"))


def curve(x: Sequence[str], lows: Sequence[float], extent: float) -> Column:
    """Place on a space-filling curve: the bits of the inputs' grid cells, interleaved."""
    used = list(zip(x, lows))[:AXES]
    bits = min(20, 60 // len(used))
    out = F.lit(0).cast("long")
    for j, (c, lo) in enumerate(used):
        cell = F.floor((F.col(c) - F.lit(lo)) / F.lit(extent) * (2 ** bits - 1)).cast("long")
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long")), b * len(used) + j))
    return out


def blocked(points: DataFrame, xs: Sequence[str], tile: int) -> DataFrame:
    """Points with ``_block``: stretches of ``tile`` points along the curve; column ``id`` breaks ties."""
    row = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{name}") for c in xs for name, f in (("lo", F.min), ("hi", F.max))]).first()
    if not row["n"]:
        return points.withColumn("_block", F.lit(0))
    lows = [row[f"{c}_lo"] for c in xs]
    extent = max(max(row[f"{c}_hi"] - row[f"{c}_lo"] for c in xs), 1e-300) * (1 + 1e-9)
    on_curve = cut(points.withColumn("_at", curve(xs, lows, extent)))
    buckets = max(1, math.ceil(row["n"] / ROWS_PER_BUCKET))
    borders = on_curve.agg(F.percentile_approx("_at", [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0] if buckets > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(borders))]), lambda b: b < F.col("_at"))) if borders else F.lit(0)
    placed = position_in_buckets(on_curve, bucket, ["_at", "id"], "_pos", ["rep"])
    return cut(placed.withColumn("_block", F.floor(F.col("_pos") / tile).cast("int")).drop("_pos", "_at"))


def box_levels(rows: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> list[DataFrame]:
    """Boxes with their smallest responses: of blocks first, then of ``FAN`` neighbouring boxes each, up to at most ``FAN`` boxes a repeat."""
    def boxes(df, node):
        return cut(df.groupBy("rep", node.cast("int").alias("node")).agg(*[F.min(f"lo{c}").alias(f"lo{c}") for c in xs],
                   *[F.max(f"hi{c}").alias(f"hi{c}") for c in xs], *[F.min(f"min{c}").alias(f"min{c}") for c in ys]))

    leaves = rows.select("rep", "_block", *[F.col(c).alias(f"{how}{c}") for c in xs for how in ("lo", "hi")], *[F.col(c).alias(f"min{c}") for c in ys])
    levels = [boxes(leaves, F.col("_block"))]
    count = (levels[0].agg(F.max("node")).first()[0] or 0) + 1
    while count > FAN:
        levels.append(boxes(levels[-1], F.floor(F.col("node") / FAN)))
        count = -(-count // FAN)
    return levels


def candidate_blocks(known: DataFrame, levels: Sequence[DataFrame], xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """``rep, _query, node`` and the boxes of blocks that may hold a nearer or a nearer better point for some point of a block.

    The levels of boxes are descended from the top, all blocks at once; a pair of boxes goes on while it lies within the
    loosest bound of the block.  Points for which no better one is known are bounded by the far corner of the nearest box that
    must hold one for all of them; the points of least response need none.
    """
    n = range(len(ys))
    least = levels[-1].groupBy("rep").agg(*[F.min(f"min{c}").alias(f"g{k}") for k, c in enumerate(ys)])
    inf = float("inf")

    def of(k):
        """Found bound, largest and lowest open response of the points that can have a better one."""
        nb, y, has = F.get("nb", F.lit(k)), F.col(ys[k]), F.col(ys[k]) > F.col(f"g{k}")
        return [F.max(F.when(has & (nb < inf), nb)).alias(f"found{k}"), F.max(F.when(has, y)).alias(f"top{k}"),
                F.min(F.when(has & (nb == inf), y)).alias(f"open{k}"), F.lit(inf).alias(f"far{k}")]

    queries = (known.join(F.broadcast(least), "rep").groupBy("rep", F.col("_block").alias("_query")).agg(  # one row per repeat
        *[F.min(c).alias(f"qlo{c}") for c in xs], *[F.max(c).alias(f"qhi{c}") for c in xs], F.max("nn").alias("nn"), *[a for k in n for a in of(k)]))
    near = F.sqrt(sum(F.pow(F.greatest(F.col(f"lo{c}") - F.col(f"qhi{c}"), F.col(f"qlo{c}") - F.col(f"hi{c}"), F.lit(0.0)), 2) for c in xs)) * (1 - SLACK)
    far = F.sqrt(sum(F.pow(F.greatest(F.col(f"hi{c}") - F.col(f"qlo{c}"), F.col(f"qhi{c}") - F.col(f"lo{c}")), 2) for c in xs)) * (1 + SLACK)
    box = [f"{how}{c}" for c in xs for how in ("lo", "hi")] + [f"min{c}" for c in ys]
    asked = [c for c in queries.columns if c not in ("rep", "_query")]
    pairs = queries.join(F.broadcast(levels[-1]), "rep")  # at most FAN boxes a repeat
    for level in range(len(levels) - 1, -1, -1):
        pairs = pairs.withColumn("_near", near).withColumn("_far", far)
        if ys:
            bounds = pairs.groupBy("rep", "_query").agg(*[F.min(F.when(F.col(f"min{c}") < F.col(f"open{k}"), F.col("_far"))).alias(f"new{k}") for k, c in enumerate(ys)])
            pairs = pairs.join(bounds, ["rep", "_query"])
            pairs = pairs.withColumns({f"far{k}": F.least(f"far{k}", F.coalesce(f"new{k}", F.lit(inf))) for k in n})
        keep = F.col("_near") <= F.col("nn")
        for k, c in enumerate(ys):
            bound = F.greatest(F.coalesce(f"found{k}", F.lit(-1.0)), F.when(F.col(f"open{k}").isNotNull(), F.col(f"far{k}")).otherwise(-1.0))
            keep = keep | (F.coalesce(F.col(f"min{c}") < F.col(f"top{k}"), F.lit(False)) & (F.col("_near") <= bound))
        pairs = cut(pairs.where(keep).select("rep", "_query", "node", *asked, *box))
        if level:
            below = levels[level - 1].withColumn("_up", F.floor(F.col("node") / FAN).cast("int"))
            pairs = pairs.select("rep", "_query", F.col("node").alias("_up"), *asked).join(below, ["rep", "_up"]).drop("_up")
    return pairs.where(F.abs(F.col("node") - F.col("_query")) > 1).select("rep", "_query", "node", *box)


def nearest(a: pd.DataFrame, b: pd.DataFrame, xs: Sequence[str], ys: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point of ``a`` in ``b``: distance to the nearest other point, and distance and id of the nearest better ones.

    Points with an equal response are not better and never candidates. Ties go to the smaller id.
    """
    b = b.sort_values("id")
    d = distances(a[xs].to_numpy(float), b[xs].to_numpy(float))
    other = b["id"].to_numpy()
    nn = np.where(a["id"].to_numpy()[:, None] == other[None, :], np.inf, d).min(axis=1)
    nb, ids = np.full((len(a), len(ys)), np.inf), np.zeros((len(a), len(ys)), dtype=other.dtype)
    for k, y in enumerate(ys):
        better = np.where(b[y].to_numpy(float)[None, :] < a[y].to_numpy(float)[:, None], d, np.inf)
        at = better.argmin(axis=1)
        nb[:, k], ids[:, k] = better[np.arange(len(a)), at], other[at]
    return nn, nb, ids


def blocks_to_search(pdf: pd.DataFrame, boxes: pd.DataFrame, xs: Sequence[str], ys: Sequence[str]) -> np.ndarray:
    """Of candidate blocks, those that may hold a nearer neighbour or a nearer better point of some point of the block.

    A point without a better one so far is bounded by the far corner of the nearest box that is known
    to hold one. Boxes without a smaller response are not opened, so a plateau costs no more than a slope.
    """
    found = np.stack(pdf["nb"]) if len(ys) else np.empty((len(pdf), 0))
    bounds, nn = found.copy(), pdf["nn"].to_numpy(float)

    def strips():
        for start in range(0, len(boxes), STRIP):
            part = boxes.iloc[start:start + STRIP]
            near, far = np.zeros((len(pdf), len(part))), np.zeros((len(pdf), len(part)))
            for c in xs:
                v, lo, hi = pdf[c].to_numpy(float)[:, None], part[f"lo{c}"].to_numpy()[None, :], part[f"hi{c}"].to_numpy()[None, :]
                near += np.maximum(np.maximum(lo - v, v - hi), 0) ** 2
                far += np.maximum(np.abs(v - lo), np.abs(v - hi)) ** 2
            better = [part[f"min{y}"].to_numpy()[None, :] < pdf[y].to_numpy(float)[:, None] for y in ys]
            yield part, np.sqrt(near) * (1 - SLACK), np.sqrt(far) * (1 + SLACK), better

    for _, _, far, better in strips():
        for k in range(len(ys)):
            bounds[:, k] = np.minimum(bounds[:, k], np.where(better[k], far, np.inf).min(axis=1))
    wanted = []
    for part, near, _, better in strips():
        need = (near <= nn[:, None]).any(axis=0)
        for k in range(len(ys)):
            need |= ((near <= bounds[:, k:k + 1]) & better[k]).any(axis=0)
        wanted.append(part["node"].to_numpy()[need])
    return np.concatenate(wanted) if wanted else np.empty(0, int)


def neighbour_search(points: DataFrame, x: Sequence[str], labels: Sequence[str], n: int, id_col: str = "sample_id") -> DataFrame:
    """``(rep, label, sample_id, nn, nb, nb_id)``, exact, for any number of points and inputs.

    Points are cut into blocks of constant size along a space-filling curve. Each block first searches itself and its
    neighbours on the curve, which bounds every search; then levels of boxes, kept as tables, are descended to the blocks
    whose box lies within a bound and, for better points, holds a smaller response, and just these are opened. A task
    holds two blocks, or a block and the boxes asked for. Many inputs make boxes overlap and the search compare more blocks, down
    to all of them; the result is the same.
    """
    labels = list(labels)
    xs, ys = [f"_x{j}" for j in range(len(x))], [f"_y{k}" for k in range(len(labels))]
    kind = points.schema[id_col].dataType.simpleString()
    rows = blocked(points.select("rep", col(id_col).alias("id"), *[col(c).cast("double").alias(a) for c, a in zip(x, xs)],
                                 *[col(c).cast("double").alias(a) for c, a in zip(labels, ys)]), xs, TILE)
    cells = ", ".join(f"{c} double" for c in [*xs, *ys])
    own = f"rep int, _block int, id {kind}, {cells}, nn double, nb array<double>, nb_id array<{kind}>"

    def first(key, pdf):
        a = pdf[pdf["_block"] == key[1]]
        out = a[["rep", "_block", "id", *xs, *ys]].copy()
        if not len(a):
            return out.assign(nn=pd.Series(dtype=float), nb=pd.Series(dtype=object), nb_id=pd.Series(dtype=object))
        nn, nb, ids = nearest(a, pdf, xs, ys)
        return out.assign(nn=nn, nb=list(nb), nb_id=list(ids))

    near = rows.withColumn("_query", F.explode(F.array(*[F.col("_block") + k for k in (-1, 0, 1)])))
    known = cut(near.groupBy("rep", "_query").applyInPandas(first, own))

    def ask(key, a, boxes):
        wanted = blocks_to_search(a, boxes, xs, ys) if len(a) and len(boxes) else np.empty(0, int)
        return pd.DataFrame({"rep": key[0], "_query": key[1], "_block": wanted}).astype("int32")

    candidates = candidate_blocks(known, box_levels(rows, xs, ys), xs, ys)
    pairs = cut(known.groupBy("rep", "_block").cogroup(candidates.withColumnRenamed("_query", "_block").groupBy("rep", "_block"))
                .applyInPandas(ask, "rep int, _query int, _block int"))
    left = known.withColumnRenamed("_block", "_query").join(pairs, ["rep", "_query"])
    right = rows.join(pairs, ["rep", "_block"])
    group = ["rep", "_query", "_block"]

    def second(key, a, b):
        out = []
        if len(a) and len(b):
            nn, nb, ids = nearest(a, b, xs, ys)
            better = nn < a["nn"].to_numpy(float)
            out.append(pd.DataFrame({"id": a["id"].to_numpy()[better], "k": -1, "dist": nn[better], "other": a["id"].to_numpy()[better]}))
            old, old_ids = np.stack(a["nb"]), np.stack(a["nb_id"])
            for k in range(len(labels)):
                better = (nb[:, k] < old[:, k]) | ((nb[:, k] == old[:, k]) & np.isfinite(nb[:, k]) & (ids[:, k] < old_ids[:, k]))
                out.append(pd.DataFrame({"id": a["id"].to_numpy()[better], "k": k, "dist": nb[better, k], "other": ids[better, k]}))
        out = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["id", "k", "dist", "other"])
        out.insert(0, "rep", key[0])
        return out

    more = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(second, f"rep int, id {kind}, k int, dist double, other {kind}")
    start = known.select("rep", "id", F.explode(F.concat(
        F.array(F.struct(F.lit(-1).alias("k"), F.col("nn").alias("dist"), F.col("id").alias("other"))),
        F.transform(F.arrays_zip("nb", "nb_id"), lambda p, i: F.struct(i.alias("k"), p["nb"].alias("dist"), p["nb_id"].alias("other"))))).alias("s"))
    every = start.select("rep", "id", "s.k", "s.dist", "s.other").unionAll(more).where(F.col("dist") < float("inf"))
    best = every.groupBy("rep", "id").agg(F.min(F.when(F.col("k") < 0, F.col("dist"))).alias("nn"), *[
        F.min(F.when(F.col("k") == k, F.struct("dist", "other"))).alias(f"b{k}") for k in range(len(labels))])
    best = rows.select("rep", "id").join(best, ["rep", "id"], "left")  # a single point has no neighbour at all
    cells_of = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"b{k}.dist").alias("nb"), F.col(f"b{k}.other").alias("nb_id"))
                         for k, c in enumerate(labels)])
    return best.select("rep", "id", "nn", F.explode(cells_of).alias("c")).select(
        "rep", "c.label", F.col("id").alias(id_col), "nn", "c.nb", "c.nb_id")
