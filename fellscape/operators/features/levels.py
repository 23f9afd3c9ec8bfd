"""Level sets (ela_level): how well a linear and a quadratic rule separate low responses from high ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fellscape.functions.columns import col, key_hash
from fellscape.operators.features.gram import merged
from fellscape.operators.position import hex_bucket
from fellscape.operators.quantile import exact_quantiles
from fellscape.operators.tables import to_long
from fellscape.session import broadcast_checked

QUANTILES = (0.10, 0.25, 0.50)
FOLDS = 10


def fold_of(id_col: str) -> Column:
    return (hex_bucket(key_hash("fold", col(id_col)), 6) % FOLDS).cast("int")


def with_levels(points: DataFrame, labels: Sequence[str], quantiles: Sequence[float], bound: int | None,
                within: Callable[[Column, Column], Column]) -> DataFrame:
    """Points with ``_l0``, ``_l1``, ...: per response, the index of the smallest quantile that holds the point.

    ``within`` compares a response with a quantile; a point that no quantile holds gets their number.
    """
    rows = to_long(points.select("rep", *[col(c) for c in labels]), labels)
    cuts = exact_quantiles(rows, ["rep", "label"], "y", quantiles, bound)
    wide = cuts.groupBy("rep").agg(*[
        F.max(F.when((F.col("label") == label) & (F.col("prob") == float(q)), F.col("q"))).alias(f"_q{i}_{k}")
        for i, label in enumerate(labels) for k, q in enumerate(quantiles)])
    wide = broadcast_checked(wide, bound)

    def level(i, label):
        out = F.lit(len(quantiles))
        for k in reversed(range(len(quantiles))):
            out = F.when(within(col(label), F.col(f"_q{i}_{k}")), F.lit(k)).otherwise(out)
        return out.cast("tinyint").alias(f"_l{i}")

    return points.join(wide, "rep").select(*[col(c) for c in points.columns], *[level(i, c) for i, c in enumerate(labels)])


def class_sums(rows: DataFrame, d: int, labels: Sequence[str], n_quantiles: int) -> DataFrame:
    """``(rep, label, level, fold, n, s, g)``: counts and sums of the inputs and their products per level and fold.

    A row serves all responses; each task returns its sums, never a row per point and response.
    """
    schema = "rep int, label string, level int, fold int, n long, s array<double>, g array<double>"
    groups = (n_quantiles + 1) * FOLDS

    def partial(batches):
        acc = {}
        for pdf in batches:
            for rep, part in pdf.groupby("rep", sort=False):
                x = part[[f"_x{j}" for j in range(d)]].to_numpy(float)
                z = np.column_stack([np.ones(len(x)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)])
                fold = part["fold"].to_numpy(np.int64)
                for k in range(len(labels)):
                    at = part[f"_l{k}"].to_numpy(np.int64) * FOLDS + fold
                    sums = np.stack([np.bincount(at, z[:, c], groups) for c in range(z.shape[1])], axis=1)
                    acc[rep, k] = acc[rep, k] + sums if (rep, k) in acc else sums
        rows = [(rep, labels[k], g // FOLDS, g % FOLDS, int(round(sums[g, 0])), sums[g, 1:d + 1], sums[g, d + 1:])
                for (rep, k), sums in acc.items() for g in range(groups) if sums[g, 0] > 0]
        yield pd.DataFrame(rows, columns=["rep", "label", "level", "fold", "n", "s", "g"])

    return merged(rows.mapInPandas(partial, schema), ["rep", "label", "level", "fold"], schema)


def discriminant(n, s, g):
    """Mean and covariance of one class."""
    mean = s / n
    return mean, (g - n * np.outer(mean, mean)) / (n - 1)


def quadratic(inverse, mean, extra):
    """``-(x - m)' W^-1 (x - m) / 2 + extra`` as coefficients of x'Ax + w'x + b."""
    return -0.5 * inverse, inverse @ mean, -0.5 * mean @ inverse @ mean + extra


def rule(kind, low, high):
    """Coefficients of the score difference low - high of one training set; None if a class is singular."""
    (n1, m1, w1), (n2, m2, w2) = low, high
    n, d = n1 + n2, len(m1)
    try:
        if kind == "lda":
            pooled = np.linalg.inv(((n1 - 1) * w1 + (n2 - 1) * w2) / (n - 2))
            one, two = quadratic(pooled, m1, np.log(n1 / n)), quadratic(pooled, m2, np.log(n2 / n))
            return np.zeros((d, d)), one[1] - two[1], one[2] - two[2]
        parts = []
        for m, w, size in ((m1, w1, n1), (m2, w2, n2)):
            sign, logdet = np.linalg.slogdet(w)
            if sign <= 0:
                return None
            parts.append(quadratic(np.linalg.inv(w), m, -0.5 * logdet + np.log(size / n)))
        return tuple(a - b for a, b in zip(*parts))
    except np.linalg.LinAlgError:
        return None


def fold_rules(sums: DataFrame, d: int, quantiles: Sequence[float]) -> DataFrame:
    """Rules trained on all folds but one, for every response, quantile and fold.

    A group here is the sums of one response by level and fold, never its points. Points below a
    quantile are those of its level and the levels before.
    """
    schema = "rep int, label string, k int, fold int, kind string, a array<double>, w array<double>, b double"

    def train(key, pdf):
        sums = {(f, c): (n, np.asarray(s, float), np.asarray(g, float).reshape(d, d))
                for f, c, n, s, g in pdf[["fold", "level", "n", "s", "g"]].itertuples(index=False)}
        out = []
        for k in range(len(quantiles)):
            for fold in range(FOLDS):
                classes = []
                for low in (True, False):
                    parts = [v for (f, level), v in sums.items() if (level <= k) == low and f != fold]
                    n = sum(p[0] for p in parts)
                    if n >= d + 2:
                        classes.append((n, *discriminant(n, sum(p[1] for p in parts), sum(p[2] for p in parts))))
                for kind in ("lda", "qda"):
                    got = rule(kind, *classes) if len(classes) == 2 else None
                    if got:
                        out.append((*key, k, fold, kind, got[0].ravel(), got[1], float(got[2])))
        return pd.DataFrame(out, columns=["rep", "label", "k", "fold", "kind", "a", "w", "b"])

    return sums.groupBy("rep", "label").applyInPandas(train, schema)


def misclassified(rows: DataFrame, rules: list, d: int, labels: Sequence[str]) -> DataFrame:
    """``(rep, label, k, kind, fold, wrong, n)`` of every task: all rules of a fold are one matrix product."""
    number = {c: i for i, c in enumerate(labels)}
    held: dict = {}
    for r in rules:
        held.setdefault((r["rep"], r["fold"]), []).append(
            (number[r["label"]], r["k"], r["kind"], np.concatenate(([r["b"]], r["w"], r["a"]))))
    schema = "rep int, label string, k int, kind string, fold int, wrong long, n long"

    def score(batches):
        acc: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(["rep", "fold"], sort=False):
                own = held.get(key, [])
                if not own:
                    continue
                x = part[[f"_x{j}" for j in range(d)]].to_numpy(float)
                z = np.column_stack([np.ones(len(x)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)])
                above = z @ np.stack([c for *_, c in own], axis=1) >= 0
                for at, (i, k, kind, _) in enumerate(own):
                    wrong = int((above[:, at] != (part[f"_l{i}"].to_numpy() <= k)).sum())
                    old = acc.get((*key, i, k, kind), (0, 0))
                    acc[(*key, i, k, kind)] = (old[0] + wrong, old[1] + len(x))
        yield pd.DataFrame([(rep, labels[i], k, kind, fold, *v) for (rep, fold, i, k, kind), v in acc.items()],
                           columns=["rep", "label", "k", "kind", "fold", "wrong", "n"])

    return rows.mapInPandas(score, schema)


def level_features(points: DataFrame, x: Sequence[str], labels: Sequence[str], id_col: str = "sample_id",
                   quantiles: Sequence[float] = QUANTILES, bound: int | None = None) -> DataFrame:
    """``ela_level.*``: mean misclassification over ten folds of both rules, and their ratio.

    A point is one row with its level per response, whatever their number. The rules are read on the
    driver: repeats x responses x quantiles x folds x 2, a number known beforehand. A fold whose
    training set is too small leaves the feature missing.
    """
    d, labels = len(x), list(labels)
    ys = [f"_y{k}" for k in range(len(labels))]
    slim = points.select("rep", fold_of(id_col).alias("fold"), *[col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(x)],
                         *[col(c).alias(y) for c, y in zip(labels, ys)])
    rows = with_levels(slim, ys, quantiles, bound, lambda y, q: y < q).drop(*ys)
    rules = fold_rules(class_sums(rows, d, labels, len(quantiles)), d, quantiles).collect()
    per_fold = (misclassified(rows, rules, d, labels).groupBy("rep", "label", "k", "kind", "fold")
                .agg((F.sum("wrong") / F.sum("n")).alias("error")))
    errors = (per_fold.groupBy("rep", "label", "k", "kind").agg(F.avg("error").alias("e"), F.count("*").alias("folds"))
              .groupBy("rep", "label", "k").agg(*[
                  F.max(F.when((F.col("kind") == kind) & (F.col("folds") == FOLDS), F.col("e"))).alias(kind) for kind in ("lda", "qda")]))
    name = F.get(F.array(*[F.lit(f"{round(100 * q):02d}") for q in quantiles]), F.col("k"))
    cells = F.array(*[F.struct(F.concat(F.lit(f"ela_level.{f}_"), name).alias("feature"), v.alias("value")) for f, v in (
        ("mmce_lda", F.col("lda")), ("mmce_qda", F.col("qda")), ("lda_qda", F.try_divide("lda", "qda")))])
    return errors.select("rep", "label", F.explode(cells).alias("f")).select("rep", "label", "f.feature", "f.value")
