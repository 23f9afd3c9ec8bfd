"""Regression fits (ela_meta) and principal components (pca): one pass over the points for all responses."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fellscape.operators.features import ROWS
from fellscape.operators.features.gram import centred, gram, solve
from fellscape.operators.rescale import Bounds

EXPLAINED = 0.9


def regressors(d: int, n: int | None = None) -> tuple[list[tuple[int, ...]], dict[str, list[int]]]:
    """Products of inputs, as tuples of input numbers, and the positions each model uses.

    The full model has x, x squared and every product of two of these. With ``n`` rows at most it
    is left out only where it cannot be fitted, having as many columns as there are rows to fit.
    """
    simple = [(i,) for i in range(d)]
    square = [(i, i) for i in range(d)]
    crossed = [(i, j) for i, j in combinations(range(d), 2)]
    full = [tuple(sorted(a + b)) for a, b in combinations(simple + square, 2)]
    wide = n is None or len({*simple, *square, *full}) < n - 1
    names = simple + square + (full if wide else crossed)
    at = {}
    for k, name in enumerate(names):
        at.setdefault(name, k)
    models = {"lin_simple": [at[n] for n in simple], "lin_w_interact": [at[n] for n in simple + crossed],
              "quad_simple": [at[n] for n in simple + square]}
    models["quad_w_interact"] = list(range(len(names))) if wide else []
    return names, models


def adjusted(n: int, r2: float, p: int) -> float:
    return 1 - (1 - r2) * (n - 1) / (n - p - 1)


def fit(n, mean, c, cols, y):
    """Adjusted R squared, slopes and intercept of one model, or None."""
    p = len(cols)
    if p == 0 or p >= n - 1 or not c[y, y] > 0:  # also refuses a response with missing values
        return None
    t = c[cols, y]
    beta = solve(c[np.ix_(cols, cols)], t)
    if beta is None:
        return None
    return adjusted(n, float(beta @ t / c[y, y]), p), beta, float(mean[y] - beta @ mean[cols])


def meta_rows(n, mean, c, d, names, models, y, centre, half):
    """Features of one response. Inputs were moved to [-1, 1]; slopes are put back on their scale."""
    out = {}
    lin = fit(n, mean, c, models["lin_simple"], y)
    if lin:
        slopes = lin[1] / half
        size = np.abs(slopes)
        out.update({"adj_r2": lin[0], "intercept": lin[2] - slopes @ centre, "coef.min": size.min(), "coef.max": size.max(),
                    "coef.max_by_min": size.max() / size.min() if size.min() > 0 else None})
    rows = {f"ela_meta.lin_simple.{k}": out.get(k) for k in ("adj_r2", "intercept", "coef.min", "coef.max", "coef.max_by_min")}
    for model in ("lin_w_interact", "quad_simple", "quad_w_interact"):
        got = fit(n, mean, c, models[model], y)
        rows[f"ela_meta.{model}.adj_r2"] = got[0] if got else None
        if model == "quad_simple":
            size = np.abs(got[1][d:] / half ** 2) if got else np.zeros(d)
            rows["ela_meta.quad_simple.cond"] = size.max() / size.min() if size.min() > 0 else None
    return rows


def spectrum(matrix: np.ndarray) -> tuple[float | None, float | None]:
    """Share of components that explain 90 % of the variance, and the share of the first."""
    if not np.all(np.isfinite(matrix)):
        return None, None
    values = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    whole = values.sum()
    if not whole > 0:
        return None, None
    share = np.cumsum(values) / whole
    return float(np.argmax(share >= EXPLAINED) + 1) / len(values), float(values[0] / whole)


def pca_rows(n, c, cols, half, y):
    """Components of the inputs (x) and of inputs and response (init), by covariance and correlation."""
    rows = {}
    for part, at in (("x", cols), ("init", [*cols, y])):
        scale = np.append(half, 1.0)[:len(at)]
        cov = c[np.ix_(at, at)] * np.outer(scale, scale) / (n - 1)
        sd = np.sqrt(np.diag(cov))
        cor = cov / np.outer(sd, sd) if np.all(sd > 0) else None
        for how, matrix in (("cov", cov), ("cor", cor)):
            shares = spectrum(matrix) if matrix is not None else (None, None)
            rows[f"pca.expl_var.{how}_{part}"], rows[f"pca.expl_var_PC1.{how}_{part}"] = shares
    return rows


def linear_features(points: DataFrame, x: Sequence[str], labels: Sequence[str], bounds: Bounds,
                    families: Sequence[str] = ("meta", "pca"), n: int | None = None) -> DataFrame:
    """``ela_meta`` and ``pca`` features of all responses from one matrix of products per repeat.

    ``n`` is the largest number of rows of a repeat, where it is known.
    """
    d, labels = len(x), list(labels)
    names, models = regressors(d, n)
    lo, hi = np.array(bounds.lower), np.array(bounds.upper)
    centre, half = (lo + hi) / 2, (hi - lo) / 2
    p = len(names)

    def expand(cells):
        u = (cells[:, :d] - centre) / half
        return np.column_stack([*[np.prod(u[:, list(name)], axis=1) for name in names], cells[:, d:]])

    def features(batches):
        for pdf in batches:
            for rep, n, s, g in pdf[["rep", "n", "s", "g"]].itertuples(index=False):
                mean, c = centred(n, s, g)
                out = []
                for k, label in enumerate(labels):
                    rows = {}
                    if "meta" in families:
                        rows.update(meta_rows(n, mean, c, d, names, models, p + k, centre, half))
                    if "pca" in families and n > 1:
                        rows.update(pca_rows(n, c, models["lin_simple"], half, p + k))
                    out += [(rep, label, f, v) for f, v in rows.items()]
                yield pd.DataFrame(out, columns=["rep", "label", "feature", "value"])

    return gram(points, ["rep"], [*x, *labels], expand).mapInPandas(features, ROWS)
