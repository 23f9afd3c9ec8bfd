"""Random functions: a catalogue grown in parallel, evaluated and filtered on sample points."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fellscape.functions.columns import col, unit_hash
from fellscape.functions.simplify import binary_pass, simplify, to_text, unary_pass
from fellscape.operators.evaluate import expression_columns, expression_moments, expression_rows
from fellscape.operators.tables import to_long, union_populations
from fellscape.session import cut

# How often each token is drawn, growth steps, and the shares of injected difficulty.
OPERANDS = [1, 2, 3, 4, 5, 6, 7]
OPERAND_WEIGHTS = [30, 5, 1, 1, 1, 1, 0]
OPERATORS = [11, 12, 13, 14, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36]
OPERATOR_WEIGHTS = [15, 15, 10, 10, 2, 2, 2, 5, 5, 2, 2, 3, 3, 3, 3, 3, 3, 1, 1, 1]
MIN_STEPS, MAX_STEPS = 8, 11
INJECTIONS = [(0.05, "noise"), (0.10, "flat"), (0.20, "multimodal"), (0.25, "highly_multimodal"),
              (0.30, "linkage_first"), (0.35, "linkage_next"), (0.40, "linkage_rotated"), (0.45, "index_scaled")]
LINKAGE = {"linkage_first": [2, 3, 12], "linkage_next": [2, 4, 12], "linkage_rotated": [5], "index_scaled": [6, 2, 13]}
MIN_VARIANCE = 1e-10

_NODE = "struct<t:int,w:double>"


def _ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _draw(u: Column, tokens: Sequence[int], weights: Sequence[int]) -> Column:
    """The first token whose cumulative share reaches ``u``."""
    total = sum(weights)
    shares = F.array(*[F.lit(c / total) for c in accumulate(weights)])
    return _let(u, lambda v: F.get(_ints(tokens), F.size(F.filter(shares, lambda c: c < v))))


def _node(token: Column, weight: Column) -> Column:
    return F.struct(token.cast("int").alias("t"), weight.cast("double").alias("w"))


def grow(func_id: Column, seed: int) -> Column:
    """Token list of a random function, grown from ``mean(x)`` by replacing leaves.

    A step walks from the root to a leaf, taking either side of a binary operator with equal
    chance, so a leaf is met with probability one half to the power of the binary operators above
    it. That weight is kept with the leaf: a step draws a leaf by weight and splices its
    replacement into the list, halving the weight when a binary operator gives it a sibling.
    """
    def step(tree: Column, k: Column) -> Column:
        u = lambda what: unit_hash(seed, what, func_id, k)

        def place(leaf_u):
            return F.aggregate(tree, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("p")), lambda acc, e: F.struct(
                (acc["s"] + e["w"]).alias("s"),
                F.when(acc["s"] + e["w"] <= leaf_u, acc["p"] + 1).otherwise(acc["p"]).alias("p")))["p"]

        def replaced(d):
            leaf = d["leaf"]
            half = leaf["w"] / 2
            old, top = _node(leaf["t"], half), _node(d["op"], F.lit(0.0))
            sibling = _node(d["operand"], half)
            return (F.when(d["op"] > 20, F.array(_node(leaf["t"], leaf["w"]), top))
                    .when(d["side"] < 0.5, F.array(old, sibling, top)).otherwise(F.array(sibling, old, top)))

        def spliced(at):
            drawn = F.struct(F.get(tree, at).alias("leaf"), _draw(u("operator"), OPERATORS, OPERATOR_WEIGHTS).alias("op"),
                             _draw(u("operand"), OPERANDS, OPERAND_WEIGHTS).alias("operand"), u("side").alias("side"))
            return F.concat(F.slice(tree, F.lit(1), at), _let(drawn, replaced), F.slice(tree, at + 2, F.size(tree)))

        return _let(_let(u("leaf"), place), spliced).cast(f"array<{_NODE}>")

    steps = MIN_STEPS + F.floor(unit_hash(seed, "steps", func_id) * (MAX_STEPS - MIN_STEPS + 1)).cast("int")
    start = F.array(_node(F.lit(2), F.lit(1.0)), _node(F.lit(33), F.lit(0.0))).cast(f"array<{_NODE}>")
    return F.transform(F.aggregate(F.sequence(F.lit(1), steps), start, step), lambda e: e["t"])


def injection_kind(u: Column) -> Column:
    kind = F.lit("none")
    for limit, name in reversed(INJECTIONS):
        kind = F.when(u < limit, name).otherwise(kind)
    return kind


def inject_linkage(rpn: Column, kind: Column) -> Column:
    """Every decision vector becomes its linked form."""
    def linked(t):
        out = F.array(t)
        for name, tokens in LINKAGE.items():
            out = F.when((kind == name) & (t == 2), _ints(tokens)).otherwise(out)
        return out

    return F.flatten(F.transform(rpn, linked))


def inject_difficulty(rpn: Column, kind: Column) -> Column:
    """Noise, plateaus, waves or linked variables on top of a function."""
    return (F.when(kind == "noise", F.concat(rpn, _ints([7, 13])))
            .when(kind == "flat", F.concat(rpn, _ints([27])))
            .when(kind == "multimodal", F.concat(rpn, rpn, _ints([28, 11])))
            .when(kind == "highly_multimodal", F.concat(rpn, rpn, _ints([28, 23, 11])))
            .otherwise(inject_linkage(rpn, kind)))


def _rewriting(pass_):
    """A rewrite of each token list of a column; a list is a few dozen tokens."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(rpn: pd.Series) -> pd.Series:
        return rpn.map(pass_, na_action="ignore")

    return run


simplified, fewer_unary, fewer_binary = _rewriting(simplify), _rewriting(unary_pass), _rewriting(binary_pass)


@F.pandas_udf(T.StringType())
def infix(rpn: pd.Series, consts: pd.Series) -> pd.Series:
    return pd.Series([to_text(r, c) for r, c in zip(rpn, consts)])


def draw_constants(rpn: Column, func_id: Column, seed: int) -> Column:
    """One value per occurrence of a constant: [1, 10) for token 1, [1, 1.1) for token 7."""
    places = F.filter(rpn, lambda t: (t == 1) | (t == 7))
    return F.transform(places, lambda t, k: F.when(t == 1, 1 + 9 * unit_hash(seed, "const", func_id, k))
                       .otherwise(1 + unit_hash(seed, "const", func_id, k) / 10))


def draw_matrices(rpn: Column, func_id: Column, seed: int, d: int) -> Column:
    """One uniform d x d matrix per rotated vector."""
    def cell(k, i, j):
        return unit_hash(seed, "matrix", func_id, k, i, j)

    return F.transform(F.filter(rpn, lambda t: t == 5), lambda t, k: F.array(*[
        F.array(*[cell(k, i, j) for j in range(d)]) for i in range(d)]))


def generate_trees(ids: DataFrame, seed: int) -> DataFrame:
    """``(func_id, injection, grown, injected)`` token lists before simplification."""
    fid = col("func_id")
    grown = ids.select("func_id", injection_kind(unit_hash(seed, "injection", fid)).alias("injection"),
                       grow(fid, seed).alias("grown"))
    return grown.withColumn("injected", inject_difficulty(col("grown"), col("injection")))


def generate_catalogue(ids: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """``(func_id, injection, rpn, consts, rots, expr)`` for every id: no id depends on another."""
    fid = col("func_id")
    trees = generate_trees(ids, seed).select("func_id", "injection", simplified("injected").alias("rpn"))
    drawn = trees.select("*", draw_constants(col("rpn"), fid, seed).alias("consts"),
                         draw_matrices(col("rpn"), fid, seed, dim).alias("rots"))
    return drawn.select("*", infix("rpn", "consts").alias("expr"))


def token_frequencies(trees: DataFrame, column: str = "grown") -> DataFrame:
    return trees.select(F.explode(column).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def function_checks(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(func, n_bad, variance, valid)`` per function, in one pass over the points.

    NaN and infinity are counted first; the variance of the others is that of the finite values.
    """
    aggs = []
    for k, c in enumerate(names):
        bad = col(c).isNull() | F.isnan(col(c)) | (F.abs(col(c)) == F.lit(float("inf")))
        aggs += [F.count_if(bad).alias(f"b{k}"), F.var_pop(F.when(~bad, col(c))).alias(f"v{k}")]
    row = wide.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("func"), F.col(f"b{k}").alias("n_bad"), F.col(f"v{k}").alias("variance"))
                      for k, c in enumerate(names)])
    return (row.select(F.explode(cells).alias("c")).select("c.*")
            .withColumn("valid", _valid("variance", "n_bad")))


def generation_stats(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count_if("valid").alias("valid"), F.count_if(F.col("n_bad") > 0).alias("not_finite"),
        F.count_if((F.col("n_bad") == 0) & ~F.col("valid")).alias("flat"), F.count(F.lit(1)).alias("total"),
        F.round(F.count_if("valid") / F.count(F.lit(1)), 2).alias("success_rate"))


CATALOGUE_SCHEMA = "func_id long, name string, injection string, rpn array<int>, consts array<double>, rots array<array<array<double>>>, expr string"
#: Candidates checked in one pass over the points; their token lists pass through the driver.
MOST_CANDIDATES = 20_000


def _valid(variance: str, bad: str) -> Column:
    return (F.col(bad) == 0) & F.coalesce(F.col(variance) >= MIN_VARIANCE, F.lit(False))


def candidate_checks(points: DataFrame, x: Sequence[str], candidates: Sequence) -> DataFrame:
    """``(func, n_bad, variance, valid)`` of any number of candidates, in one pass over the points."""
    return expression_moments(points, x, candidates).select("func", "n_bad", "variance", _valid("variance", "n_bad").alias("valid"))


def first_valid(points: DataFrame, x: Sequence[str], candidates: Sequence[dict], n: int) -> tuple[list[dict], DataFrame]:
    """The first ``n`` valid candidates in their order, renamed ``rgf1`` and so on, and the checks of all."""
    checks = cut(candidate_checks(points, x, candidates))
    valid = {r["func"] for r in checks.where("valid").select("func").collect()}
    chosen = [c for c in candidates if c["name"] in valid][:n]
    return [{**c, "name": f"rgf{k + 1}"} for k, c in enumerate(chosen)], checks


def _chosen(points: DataFrame, x: Sequence[str], n: int, seed: int, most: int) -> tuple[list[dict], DataFrame]:
    """Drawn candidates in growing batches until ``n`` are valid; as a rule one or two passes over the points."""
    spark = points.sparkSession
    points = cut(points.select(*[col(c) for c in x]))
    found, checked, start, size = [], [], 0, max(64, 3 * n)
    while len(found) < n and start < most:
        size = min(size, MOST_CANDIDATES, most - start)
        ids = spark.range(start, start + size).select(F.col("id").alias("func_id"))
        rows = [{**r.asDict(recursive=True), "name": f"g{r['func_id']}"} for r in generate_catalogue(ids, len(x), seed).collect()]
        chosen, checks = first_valid(points, x, sorted(rows, key=lambda r: r["func_id"]), n - len(found))
        found += chosen
        checked.append(checks)
        start, size = start + size, 2 * size
    if len(found) < n:
        raise RuntimeError(f"{len(found)} of {n} functions are valid after {start} candidates")
    return [{**r, "name": f"rgf{k + 1}"} for k, r in enumerate(found)], union_populations(checked)


def _catalogue_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in ("func_id", "name", "injection", "rpn", "consts", "rots", "expr")) for r in rows], CATALOGUE_SCHEMA)


def first_n_valid(points: DataFrame, x: Sequence[str], n: int, seed: int = 42, id_col: str = "sample_id",
                  most: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first ``n`` valid functions by id: catalogue, values beside the columns of ``points``, and the checks.

    A candidate is valid if all its values are finite and their variance is at least ``MIN_VARIANCE``.  After ``most``
    candidates the search gives up with an error.
    """
    rows, checks = _chosen(points, x, n, seed, most)
    wide, _ = expression_columns(points, x, rows, keep=points.columns)
    return _catalogue_table(points.sparkSession, rows), wide, checks


def generate_responses(points: DataFrame, x: Sequence[str], n: int, seed: int = 42, id_col: str = "sample_id",
                       most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Catalogue and long responses of the first ``n`` valid functions."""
    rows, _ = _chosen(points, x, n, seed, most)
    return _catalogue_table(points.sparkSession, rows), expression_rows(points, x, rows, id_col)


def evaluate_by_id(points: DataFrame, x: Sequence[str], catalogue: DataFrame, names: Sequence[str],
                   id_col: str = "sample_id") -> DataFrame:
    """Stored functions looked up by name and applied to any table of points."""
    rows = catalogue.where(F.col("name").isin(list(names))).collect()
    missing = set(names) - {r["name"] for r in rows}
    if missing:
        raise KeyError(f"no such function: {sorted(missing)}")
    wide, cols = expression_columns(points, x, rows, keep=[id_col])
    return to_long(wide, cols)
