"""Rank correlations in strips against all pairs of rows."""

import math

import numpy as np
import pytest

from fellscape.operators import correlate, ranks


def brute_kendall(x, y):
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    ta, tb = (dx ** 2).sum(), (dy ** 2).sum()
    return None if not ta or not tb else (dx * dy).sum() / math.sqrt(ta) / math.sqrt(tb)


def mean_rank(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def brute_spearman(x, y):
    both = ~(np.isnan(x) | np.isnan(y))
    a, b = mean_rank(x[both]), mean_rank(y[both])
    a, b = (a - a.mean(), b - b.mean()) if len(a) else (a, b)
    return None if not len(a) or not (a @ a) or not (b @ b) else (a @ b) / math.sqrt(a @ a) / math.sqrt(b @ b)


def table(rng, n):
    base = rng.normal(size=n)
    x = np.column_stack([base, base + rng.normal(size=n), np.round(base * 2), rng.integers(0, 4, n), np.where(rng.random(n) < 0.4, 7.0, base), -base ** 3,
                         np.full(n, 3.0), np.full(n, np.nan)])
    x[rng.random(n) < 0.2, 1] = np.nan
    x[rng.random(n) < 0.1, 3] = np.nan
    x[:, 5] = np.where(np.isnan(x[:, 1]), np.nan, x[:, 5])  # missing in the same rows as another column
    x[0, 0], x[1, 0] = -0.0, 0.0
    return x


@pytest.mark.parametrize("strip", [8, 50, 1 << 16])
def test_against_all_pairs(spark, strip):
    x = table(np.random.default_rng(strip), 400)
    names = [f"f{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in names)).repartition(5)
    for how, brute in ((ranks.kendall, brute_kendall), (ranks.spearman, brute_spearman)):
        got = {(r["i"], r["j"]): r["r"] for r in how(df, names, strip).collect()}
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                want = brute(x[:, i], x[:, j])
                assert got.get((i, j)) is None if want is None else got[i, j] == pytest.approx(want, abs=1e-9)


def test_counting():
    rng = np.random.default_rng(2)
    for m in (0, 1, 2, 3, 17, 300):
        for top in (1, 2, 10, 1000):
            r = rng.integers(0, top, m)
            assert ranks.inversions(r) == sum(int((r[:k] > r[k]).sum()) for k in range(m))
    x, y = rng.integers(0, 9, 200).astype(float), rng.integers(0, 30, 200).astype(float)
    part = np.searchsorted([5, 9, 20], y)
    same = part[:, None] == part[None]
    sign = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    assert ranks.excess(x, y) == sign.sum() / 2 and ranks.excess(x, y, part) == (sign * same).sum() / 2


def test_strips_stay_small(spark):
    """A value of a third of all rows is a bucket of its own, and no strip of other values grows with it."""
    n = 30_000
    df = spark.range(n).selectExpr("cast(case when id % 3 = 0 then 5 else id end as double) AS c0", "cast(id * 7919 % 30011 as double) AS c1")
    rows = ranks.numbered(df, ["c0", "c1"])
    for borders, values in zip(ranks.borders_of(rows, 2, 1000), np.array(rows.select("c0", "c1").collect()).T):
        at, size = np.unique(ranks.bucket_of(values, borders), return_counts=True)
        assert size[at % 2 == 0].max() < 2500
    got = {(r["ord_a"], r["ord_b"]): r["r"] for r in correlate.corr_matrix(df, ["c0", "c1"], "kendall").collect()}
    assert abs(got[0, 1]) < 0.05


def test_empty_and_single(spark):
    for n in (0, 1):
        df = spark.range(n).selectExpr("cast(id as double) a", "cast(id as double) b")
        for method in ("kendall", "spearman", "pearson"):
            assert all(r["r"] is None for r in correlate.corr_matrix(df, ["a", "b"], method).collect())
