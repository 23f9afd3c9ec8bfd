"""Properties and hand-worked cases that SQL does not cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellscape import Study
from fellscape.functions import benchmarks
from fellscape.functions.program import Program
from fellscape.functions.simplify import simplify, to_text
from fellscape.operators import clean, cluster, correlate, design, position, sample, standardize, tiles
from fellscape.operators.features import dispersion, neighbours, walk
from fellscape.operators.rescale import Bounds, rescale_affine
from fellscape.plans import analyze, catalogue, compute
from fellscape.queries import views as v
from fellscape.sources import doe, store

X = ["x1", "x2"]


@pytest.fixture(scope="module")
def cloud(spark):
    """300 random points in the box, with a smooth and a wavy response."""
    rng = np.random.default_rng(3)
    x = rng.uniform(-5, 5, (300, 2))
    y = np.column_stack([(x ** 2).sum(axis=1), np.sin(x).sum(axis=1)])
    y = (y - y.min(axis=0)) / (y.max(axis=0) - y.min(axis=0))
    rows = [(0, i, *map(float, x[i]), *map(float, y[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "rep int, sample_id long, x1 double, x2 double, a double, b double").cache(), x, y


@pytest.mark.parametrize("d", [2, 3])
def test_benchmark_optimum(spark, d):
    x = [f"x{i + 1}" for i in range(d)]
    rows = [(f, *benchmarks.x_opt(f, 1, d)) for f in benchmarks.FIDS]
    df = spark.createDataFrame(rows, "fid int, " + ", ".join(f"{c} double" for c in x))
    for fid in benchmarks.FIDS:
        prog = Program()
        benchmarks.add_function(prog, x, fid, 1, "y")
        got = prog.apply(df.where(F.col("fid") == fid), ["fid"]).first()["y"]
        assert abs(got - benchmarks.f_opt(fid, 1)) < 1e-6, fid
        near = prog.apply(rescale_affine(df, Bounds.cube(x, -5, 5), Bounds.cube(x, -4.5, 4.9)), ["fid"])
        assert near.agg(F.min("y")).first()[0] >= benchmarks.f_opt(fid, 1) - 1e-9, fid


def test_published_instance():
    assert benchmarks.f_opt(1, 1) == pytest.approx(79.48)
    assert benchmarks.x_opt(1, 1, 2) == pytest.approx((0.2528, -1.1568))


def test_latin_hypercube_fills_every_stratum(spark):
    n = 500
    pts = design.doe_create(spark, "lhs", n, [0.0, 0.0], [1.0, 1.0], seed=5)
    for c in X:
        strata = pts.select(F.floor(F.col(c) * n).alias("s")).distinct().count()
        assert strata == n


def test_sobol_prefix(spark):
    got = {r["sample_id"]: (r["x1"], r["x2"]) for r in design.doe_create(spark, "sobol", 4, [0, 0], [1, 1]).collect()}
    assert got == {0: (0.0, 0.0), 1: (0.5, 0.5), 2: (0.75, 0.25), 3: (0.25, 0.75)}


@pytest.mark.parametrize("bad", [("x", 3, [0], [1]), ("lhs", 0, [0], [1]), ("lhs", 3, [0, 1], [1]), ("lhs", 3, [1], [1])])
def test_design_errors(spark, bad):
    with pytest.raises(ValueError):
        design.doe_create(spark, *bad)


@pytest.mark.parametrize("n,ratio", [(1, 0.5), (7, 0.8), (1000, 0.8), (1000, 0.001)])
def test_subsample_size(spark, n, ratio):
    df = spark.range(n).withColumnRenamed("id", "sample_id")
    got = sample.subsample(df, "sample_id", ratio, 3).groupBy("rep").agg(F.countDistinct("sample_id").alias("n")).collect()
    assert [r["n"] for r in got] == [math.ceil(n * ratio)] * 3


def test_results_do_not_depend_on_partitions(spark, cloud):
    df, _, _ = cloud
    def run():
        chosen = sample.subsample(df.select("sample_id"), "sample_id", 0.5, 1)
        near = neighbours.neighbour_search(df, X, ["a", "b"], 300)
        return (sorted(r["sample_id"] for r in chosen.collect()),
                sorted((r["label"], r["sample_id"], r["nn"], r["nb"], r["nb_id"]) for r in near.collect() if r["nb"]))
    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_positions_with_any_bucket_count(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    for rows in (1000, 300, 4):
        got = position.add_position(df, "k", "p", rows).where("k <> p").count()
        assert got == 0


# ---- cleaning ------------------------------------------------------------------------------------------

def test_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, 2.0), (2.0, None, 5.0, None)], "a double, b double, c double, d double")
    assert clean.drop_cols_constant(df).columns == ["a", "b"]
    assert clean.drop_cols_all_null(df).columns == ["a", "c", "d"]
    assert clean.drop_cols_any_null(df).columns == ["a", "c"]


def test_incomplete_rows_change_what_is_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, None)], "a double, b double")
    out, report = clean.clean_table(df, rows_any_null=True)
    assert out.columns == ["b"] and [tuple(r) for r in report.collect()] == [("constant", "a")]


def test_first_row_wins(spark):
    df = spark.createDataFrame([(2, 1.0, 20.0), (1, 1.0, 10.0), (3, -0.0, 30.0), (4, 0.0, 40.0)], "sample_id long, x double, y double")
    got = sorted((r["sample_id"], r["y"]) for r in clean.dedup_keep_first(df, ["x"], "sample_id").collect())
    assert got == [(1, 10.0), (3, 30.0)]


def test_literal_lists(spark):
    df = spark.createDataFrame([("[1.0, -2.5e-07, 0.0]",), ("[nan, inf, -inf]",), ("[]",), ("no list",)], "t string")
    got = [r[0] for r in df.select(doe.parse_literal_list("t")).collect()]
    assert got[0] == [1.0, -2.5e-07, 0.0] and got[2] == [] and got[3] is None
    assert math.isnan(got[1][0]) and got[1][1:] == [math.inf, -math.inf]


def test_bad_cells_are_reported(spark):
    df = spark.createDataFrame([(1, "1.5", "2"), (2, "oops", "3")], "sample_id long, a string, b string")
    with pytest.raises(ValueError, match="a=1"):
        doe.load_doe(df, doe.ColumnSpec((("a", "x"),), (("b", "y"),)), "sample_id")


# ---- selection -------------------------------------------------------------------------------------------

def test_two_features_drop_the_earlier(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "a double, b double")
    kept, report = correlate.drop_correlated(df, ["a", "b"], 0.9)
    row = report.first()
    assert kept.columns == ["b"] and row["corr_a_mean"] is None and (row["feat_a"], row["feat_b"]) == ("b", "a")


def test_direct_mode_is_signed(spark):
    df = spark.createDataFrame([(1.0, -2.0, 1.1), (2.0, -4.0, 2.0), (3.0, -6.0, 3.2)], "a double, b double, c double")
    assert correlate.drop_correlated(df, ["a", "b", "c"], 0.9, mode="direct")[0].columns == ["a", "b"]
    with pytest.raises(ValueError):
        correlate.drop_correlated(df, ["a", "b"], mode="other")


def test_zscore(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (6.0, 4.0)], "a double, b double")
    z = standardize.zscore_transform(df, standardize.zscore_fit(df, ["a", "b"]))
    row = z.agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1) and row[2] == 0.0


def test_missing_labels(spark):
    feats = spark.createDataFrame([("problem_a", "f", 1.0)], "label string, feature string, value double")
    ask = lambda *labels: spark.createDataFrame([(l,) for l in labels], "label string")
    assert store.read_features_tolerant(feats, ask("problem_a", "rgf9")).count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_features_tolerant(feats, ask("problem_a", "bbob_f1_ins1"))


# ---- generated functions ------------------------------------------------------------------------------------

@pytest.mark.parametrize("rpn,want", [
    ([2, 21, 21, 33], [2, 33]), ([2, 24, 25, 33], [2, 33]), ([2, 26, 25, 33], [2, 25, 33]), ([2, 25, 26, 33], [2, 25, 33]),
    ([2, 3, 12, 21, 33], [3, 2, 12, 33]), ([2, 3, 14, 22, 33], [3, 2, 14, 33]), ([3, 33], [3]),
    ([1, 1, 11, 2, 13, 33], [1, 2, 13, 33]), ([2, 3, 21, 11, 33], [2, 3, 12, 33]), ([2, 3, 22, 13, 33], [2, 3, 14, 33]),
    ([2, 21, 3, 11, 33], [3, 2, 12, 33]), ([1, 2, 1, 12, 12, 33], [1, 2, 12, 33]), ([1, 1, 2, 12, 12, 33], [1, 2, 11, 33]),
    ([2, 34, 33], [2, 34, 33])])
def test_simplify(rpn, want):
    assert simplify(rpn) == want


def test_text():
    assert to_text([2, 3, 11, 2, 13, 28, 33], []) == "mean(sin(2*pi*x+x[1]*x))"


def test_catalogue_is_well_formed(spark):
    rows = catalogue.generate_trees(spark.range(200).withColumnRenamed("id", "func_id"), 1).collect()
    for r in rows:
        for name in ("grown", "injected"):
            depth = 0
            for t in r[name]:
                depth += 1 if t < 10 else (-1 if t < 20 else 0)
                assert depth >= 1
            assert depth == 1
        steps = len([t for t in r["grown"] if t > 10]) - 1
        assert catalogue.MIN_STEPS <= steps <= catalogue.MAX_STEPS and r["grown"][-1] == 33
    again = catalogue.generate_trees(spark.range(100, 200).withColumnRenamed("id", "func_id").repartition(3), 1)
    assert {r["func_id"]: r["grown"] for r in again.collect()}.items() <= {r["func_id"]: r["grown"] for r in rows}.items()


def test_token_shares(spark):
    trees = catalogue.generate_trees(spark.range(3000).withColumnRenamed("id", "func_id"), 9)
    n = {r["token"]: r["n"] for r in catalogue.token_frequencies(trees).collect()}
    whole = sum(v for t, v in n.items() if t > 10) - 3000
    for token, weight in zip(catalogue.OPERATORS, catalogue.OPERATOR_WEIGHTS):
        got = (n.get(token, 0) - (3000 if token == 33 else 0)) / whole
        assert got == pytest.approx(weight / sum(catalogue.OPERATOR_WEIGHTS), abs=0.01)


def test_valid_functions(spark, sf):
    rows, wide, checks = catalogue.first_n_valid(v.part_inputs(spark, sf), X, 3, seed=4)
    assert [r["name"] for r in rows.orderBy("func_id").collect()] == ["rgf1", "rgf2", "rgf3"]
    for name in ("rgf1", "rgf2", "rgf3"):
        row = wide.agg(F.count_if(F.isnan(name) | F.col(name).isNull()), F.var_pop(name)).first()
        assert row[0] == 0 and row[1] >= catalogue.MIN_VARIANCE


# ---- features against brute force ---------------------------------------------------------------------------------

def test_neighbours(spark, cloud):
    df, x, y = cloud
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = {(r["label"], r["sample_id"]): r for r in neighbours.neighbour_search(df, X, ["a", "b"], 300).collect()}
    for k, label in enumerate("ab"):
        for i in range(300):
            better = np.where(y[:, k] < y[i, k], d[i], np.inf)
            r = got[label, i]
            assert r["nn"] == pytest.approx(d[i].min())
            assert r["nb"] is None if np.isinf(better.min()) else (r["nb"] == pytest.approx(better.min()) and r["nb_id"] == better.argmin())


@pytest.mark.parametrize("d,tile", [(2, 32), (2, 1024), (5, 64), (9, 100)])
def test_neighbours_over_blocks(spark, monkeypatch, d, tile):
    """Many blocks, a tight cluster, a step, a plateau, tied distances and a constant response."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.uniform(-5, 5, (300, d)), 1.0 + 1e-3 * rng.uniform(0, 1, (150, d)), np.round(rng.uniform(-5, 5, (150, d)))])
    x = np.unique(x, axis=0)
    n = len(x)
    y = np.column_stack([np.round((x ** 2).sum(axis=1), 1), (x[:, 0] > -4.9).astype(float), np.zeros(n)])
    y[:5, 0] = y[:, 0].min()
    names = [f"x{j + 1}" for j in range(d)]
    df = spark.createDataFrame([(0, i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(x, y))],
                               "rep int, sample_id long, " + ", ".join(f"{c} double" for c in [*names, "a", "b", "c"])).cache()
    monkeypatch.setattr(neighbours, "TILE", tile)
    got = {(r["label"], r["sample_id"]): r for r in neighbours.neighbour_search(df, names, ["a", "b", "c"], n).collect()}
    assert len(got) == 3 * n
    dist = tiles.distances(x, x)
    np.fill_diagonal(dist, np.inf)
    for k, label in enumerate("abc"):
        better = np.where(y[None, :, k] < y[:, None, k], dist, np.inf)
        for i in range(n):
            r = got[label, i]
            assert r["nn"] == dist[i].min()
            want = (None, None) if np.isinf(better[i].min()) else (better[i].min(), better[i].argmin())
            assert (r["nb"], r["nb_id"]) == want


def test_neighbours_over_thousands_of_blocks(spark, monkeypatch):
    """Boxes in three levels, none of which is read on the driver; few block pairs are asked for."""
    rng = np.random.default_rng(6)
    n = 8400
    x = rng.uniform(-5, 5, (n, 2))
    y = (x ** 2).sum(axis=1) + 3 * np.sin(3 * x).sum(axis=1)
    df = spark.createDataFrame([(0, i, *map(float, p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "rep int, sample_id long, x1 double, x2 double, a double")
    monkeypatch.setattr(neighbours, "TILE", 4)
    levels, candidates, real_levels, real = [], [], neighbours.box_levels, neighbours.candidate_blocks
    monkeypatch.setattr(neighbours, "box_levels", lambda *a: levels.append(real_levels(*a)) or levels[-1])
    monkeypatch.setattr(neighbours, "candidate_blocks", lambda *a: candidates.append(real(*a)) or candidates[-1])
    got = {r["sample_id"]: r for r in neighbours.neighbour_search(df, X, ["a"], n).collect()}
    assert [t.count() for t in levels[0]] == [2100, 66, 3] and candidates[0].count() < 0.05 * 2100 ** 2
    for i in range(n):
        d = np.sqrt((x[:, 0] - x[i, 0]) ** 2 + (x[:, 1] - x[i, 1]) ** 2)
        d[i] = np.inf
        better = np.where(y < y[i], d, np.inf)
        assert got[i]["nn"] == pytest.approx(d.min()) and (got[i]["nb_id"] is None if np.isinf(better.min()) else got[i]["nb_id"] == better.argmin())


def test_blocks_agree_with_one_block(spark, cloud, monkeypatch):
    df, x, y = cloud
    want = {(r["label"], r["feature"]): r["value"] for r in dispersion.dispersion_features(df, X, ["a", "b"], Bounds.cube(X), 300, [0]).collect()}
    monkeypatch.setattr(dispersion, "TILE", 64)
    monkeypatch.setattr(dispersion, "EXACT", 50)  # forces several refinements
    monkeypatch.setattr(dispersion, "BINS", 32)
    got = {(r["label"], r["feature"]): r["value"] for r in dispersion.dispersion_features(df, X, ["a", "b"], Bounds.cube(X), 300, [0]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    all_d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(300, 1)]
    low = x[y[:, 0] <= np.quantile(y[:, 0], 0.1)]
    some = np.sqrt(((low[:, None] - low[None]) ** 2).sum(axis=2))[np.triu_indices(len(low), 1)]
    assert got["a", "disp.ratio_median_10"] == pytest.approx(np.median(some) / np.median(all_d))


def test_walk_blocks(spark, cloud, monkeypatch):
    df, _, _ = cloud
    want = {(r["label"], r["feature"]): r["value"] for r in walk.walk_features(df, X, ["a", "b"], 300).collect()}
    monkeypatch.setattr(walk, "BLOCK", 7)
    got = {(r["label"], r["feature"]): r["value"] for r in walk.walk_features(df, X, ["a", "b"], 300).collect()}
    assert got == pytest.approx(want)


def test_ward(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(14, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "leaf long, a double, b double, c double")
    got = [tuple(r) for r in cluster.ward_linkage(df, ["a", "b", "c"], "leaf").orderBy("step").collect()]
    groups, want = {i: (pts[i], 1) for i in range(14)}, []
    for step in range(13):
        pairs = [(math.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(ca - cb), i, j)
                 for i, (ca, na) in groups.items() for j, (cb, nb) in groups.items() if i < j]
        h, i, j = min(pairs)
        (ca, na), (cb, nb) = groups.pop(i), groups.pop(j)
        groups[14 + step] = ((na * ca + nb * cb) / (na + nb), na + nb)
        want.append((step, i, j, h, na + nb))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    rounds = cluster.ward_rounds(df, ["a", "b", "c"], "leaf")
    flat = cluster.cut_clusters(df.select("leaf"), rounds, want[-2][3], "leaf")
    assert flat.select("cluster").distinct().count() == 3  # the two highest merges are cut


@pytest.mark.parametrize("tied", [False, True])
def test_ward_rounds_search_changed_clusters_only(spark, monkeypatch, tied):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(70, 2)) if not tied else np.stack(np.meshgrid(np.arange(6.0), np.arange(6.0)), -1).reshape(-1, 2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "leaf long, a double, b double")
    key = lambda r: (r["leaf_a"], r["leaf_b"])
    want = {key(r): r["height"] for r in cluster.ward_rounds(df, ["a", "b"], "leaf").collect()}
    asked, real = [], cluster._nearest
    monkeypatch.setattr(cluster, "_nearest", lambda q, c, nq, n: asked.append((nq, n)) or real(q, c, nq, n))
    monkeypatch.setattr(cluster, "FEW", 6)
    monkeypatch.setattr(cluster, "TILE", 8)
    got = {key(r): r["height"] for r in cluster.ward_rounds(df, ["a", "b"], "leaf").collect()}
    assert len(got) == len(pts) - 1 and sorted(got.values()) == pytest.approx(sorted(want.values()))
    assert asked[0][0] == asked[0][1] == len(pts) and any(nq < n for nq, n in asked[1:])
    if not tied:
        assert got == pytest.approx(want)


def test_study(spark, sf):
    study = Study(bounds=v.PART_BOUNDS, responses=("y1", "flat"), bootstrap=False, fids=(1, 2, 3), generated=1,
                  families=("ela_meta", "ela_distr", "pca"))
    done = compute.compute_features_many(study, v.doe_part(spark, sf).dropna().withColumn("flat", F.lit(3.0)))
    status = {(r["label"], r["family"]): r["status"] for r in done.status.collect()}
    assert status["problem_flat", "ela_meta"] == "failed" and status["problem_y1", "ela_meta"] == "ok"
    assert {r["label"] for r in done.features.select("label").distinct().collect()} == {
        "problem_y1", "problem_flat", "bbob_f1_ins1", "bbob_f2_ins1", "bbob_f3_ins1", "rgf1"}
    with pytest.raises(ValueError):
        Study(bounds=v.PART_BOUNDS, responses=("y1",), ratio=1.0)
