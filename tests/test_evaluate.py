"""Functions at points: both forms of evaluation, code size of stages, and many generated functions at once."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from fellscape.functions import benchmarks
from fellscape.functions.program import ARRAYS, Program
from fellscape.functions.simplify import binary_pass, simplify, unary_pass
from fellscape.operators import evaluate
from fellscape.plans import catalogue as cat
from fellscape.queries import functions as q, views as v


def largest_method(df):
    """Bytes of the largest method of each compiled stage of a plan; -1 where a stage does not compile."""
    debug = df.sparkSession._jvm.org.apache.spark.sql.execution.debug
    stages = getattr(debug, "package$").__getattr__("MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]


def test_stages_compile(spark, sf):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for functions in ([(f, 1) for f in benchmarks.FIDS], [(21, 1), (21, 2)], [(3, 1), (15, 1)], [(1, 1)]):
            df = evaluate.apply_functions(q.line_points(spark, sf), q.X3, functions).groupBy("label").agg(F.avg("y").alias("y"))
            sizes = largest_method(df)
            assert sizes and all(0 < s < 65_535 for s in sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_both_forms_agree(spark, sf, monkeypatch):
    points = v.part_inputs(spark, sf)
    few = [(f, 1) for f in benchmarks.FIDS if f not in (21, 23)]
    results = []
    for most in (10 ** 9, 0):
        monkeypatch.setattr(evaluate, "MOST_OPERATIONS", most)
        out = []
        for f in few:
            wide, names = evaluate.benchmark_columns(points, q.X, [f], keep=["sample_id"])
            out.append({r[0]: r[1] for r in wide.collect()})
        wide, _ = evaluate.expression_columns(points, q.X, q.FIXED, keep=["sample_id"])
        results.append((out, {r[0]: tuple(r)[1:] for r in wide.collect()}))
    for a, b in zip(results[0][0], results[1][0]):
        assert all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)
    same = lambda x, y: x == pytest.approx(y, rel=1e-9, nan_ok=True)
    assert all(same(x, y) for i, r in results[0][1].items() for x, y in zip(r, results[1][1][i]))


def test_missing_coordinates(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 1.0, None)], "sample_id long, x1 double, x2 double")
    rows = evaluate.expression_rows(points, q.X, q.FIXED[:2]).collect()
    assert all((r["y"] is None) == (r["sample_id"] > 1) for r in rows) and len(rows) == 6
    moments = {r["func"]: r for r in evaluate.expression_moments(points, q.X, q.FIXED[:2]).collect()}
    assert all(r["n_bad"] == 2 and r["n"] == 1 and r["variance"] == 0 for r in moments.values())
    assert evaluate.expression_moments(points.limit(0), q.X, q.FIXED[:1]).count() == 0


def test_variance_of_large_means(spark):
    """Sums of squares would lose a variance this far below the square of the mean."""
    points = spark.range(40_000).select(F.col("id").alias("sample_id"), (F.col("id") % 2 * 1e-3).alias("x1"), F.lit(0.0).alias("x2")).repartition(7)
    row = {"name": "f", "rpn": [3, 1, 11], "consts": [1e7], "rots": []}
    assert evaluate.expression_moments(points, q.X, [row]).first()["variance"] == pytest.approx(2.5e-7, rel=1e-3)


def test_a_thousand_valid_functions(spark, sf):
    points = v.part_inputs(spark, sf)
    catalogue, long = cat.generate_responses(points, q.X, 1000, seed=8)
    assert [r["name"] for r in catalogue.orderBy("func_id").select("name").collect()] == [f"rgf{k}" for k in range(1, 1001)]
    checks = long.groupBy("label").agg(F.count_if(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == math.inf)).alias("bad"),
                                       F.count("*").alias("n"), F.var_pop("y").alias("variance")).collect()
    assert len(checks) == 1000 and all(r["bad"] == 0 and r["n"] == 200 and not r["variance"] < 0.99 * cat.MIN_VARIANCE for r in checks)


def test_candidates_against_statistics(spark, sf):
    points = v.part_inputs(spark, sf)
    rows, checks = cat.first_valid(points, q.X, q.CANDIDATES, 4)
    assert [r["func_id"] for r in rows] == [1, 3, 4, 5] and checks.count() == len(q.CANDIDATES)
    values = [r["y"] for r in evaluate.expression_rows(points, q.X, rows[:1]).collect()]
    assert checks.where("func = 'rgf3'").first()["variance"] == pytest.approx(statistics.pvariance(values), rel=1e-9)
    with pytest.raises(RuntimeError):
        cat.first_n_valid(points, q.X, 50, seed=4, most=10)


def test_operations_are_counted():
    sizes = {}
    for f in benchmarks.FIDS:
        prog = Program(ARRAYS)
        benchmarks.add_function(prog, ["_x0", "_x1", "_x2"], f)
        sizes[f] = prog.size()
    assert sizes[1] < 20 < sizes[3] < sizes[22] < sizes[21]


@pytest.mark.parametrize("rpn, want", [
    ([2, 22, 3, 21, 13], [2, 22, 3, 21, 13]), ([2, 21, 3, 22, 11], [2, 21, 3, 22, 11]),  # the first matching branch ends the search
    ([2, 3, 22, 21, 11], [2, 3, 22, 12]), ([2, 3, 21, 12], [2, 3, 11]), ([2, 3, 22, 14], [2, 3, 13]), ([2, 22, 3, 13], [3, 2, 14]), ([2, 22, 3, 14], [2, 22, 3, 14]),
    ([2, 21, 3, 12], [2, 21, 3, 12]), ([1, 2, 1, 12, 11], [1, 2, 11]), ([1, 1, 2, 11, 11], [1, 2, 11]), ([1, 1, 2, 12, 11], [1, 2, 12]), ([1, 1, 2, 14, 14], [1, 2, 13]),
    ([2, 1, 11, 3, 1, 12, 12], [2, 1, 11, 3, 12]), ([2, 1, 13, 1, 3, 14, 14], [2, 1, 13, 3, 13]), ([2, 1, 11, 1, 11], [2, 1, 11, 1, 11]), ([1, 2, 1, 13, 11], [1, 2, 1, 13, 11])])
def test_binary_rules(rpn, want):
    assert binary_pass(rpn) == want


@pytest.mark.parametrize("rpn, want", [
    ([2, 33, 34], [2, 33]), ([2, 34, 33], [2, 34, 33]), ([2, 26, 26], [2, 26]), ([2, 25, 26], [2, 25]), ([2, 26, 30], [2, 30]), ([2, 22, 22], [2]),
    ([2, 31, 30], [2]), ([2, 25, 24], [2]), ([2, 3, 14, 22], [3, 2, 14]), ([2, 3, 11, 21], [2, 3, 11, 21]), ([2, 21, 21, 21], [2, 21]), ([3, 7, 11, 35], [3, 7, 11])])
def test_unary_rules(rpn, want):
    assert unary_pass(rpn) == want


def test_order_of_passes():
    """A second unary pass takes what the first binary pass has made."""
    assert simplify([2, 1, 1, 11, 33, 11, 33]) == simplify([2, 1, 11, 33]) == [2, 1, 11, 33]
    assert simplify([2, 3, 21, 21, 11, 33]) == [2, 3, 11, 33]
