"""Queries of the function language, the generated functions and the benchmark functions."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import functions as F

from fellscape.functions import benchmarks
from fellscape.functions.columns import col, single, tidy
from fellscape.functions.expression import add_expression, unknown_tokens
from fellscape.functions.program import DUCKDB, Program
from fellscape.operators import evaluate, tables
from fellscape.plans import catalogue as cat
from fellscape.queries import views as v
from fellscape.queries.registry import add, query
from fellscape.session import run_path, spread
from fellscape.sources import store

X = ["x1", "x2"]
TURN = [[[0.25, 0.5], [0.75, 0.125]]]


def _expression(rpn, consts=(), rots=(), semantics="text"):
    def run(spark, sf):
        prog = Program()
        add_expression(prog, X, "y", rpn, consts, rots, semantics)
        return prog.apply(v.part_inputs(spark, sf), ["sample_id"]).withColumn("y", tidy("y"))
    return run


def _by_hand(text):
    return f"WITH {v.PART_INPUTS} SELECT sample_id, {v.t(text)} AS y FROM pts"


def each(text):
    """Mean over the two coordinates of a text in ``x``."""
    return "(" + " + ".join(text.replace("{x}", x) for x in X) + ") / 2.0::DOUBLE"


TWO_PI = f"{2 * math.pi!r}::DOUBLE"
# name: (token list, constants, matrices, the same formula by hand)
TOKENS = {
    "fn_constant": ([2, 1, 11, 33], [3.75], (), each("({x} + 3.75)")),
    "fn_vector": ([2, 33], (), (), "(x1 + x2) / 2"),
    "fn_first": ([3], (), (), "x1"),
    "fn_shifted": ([4, 33], (), (), "x2 / 2"),
    "fn_rotated": ([5, 33], (), TURN, "((x1 * 0.25 + x2 * 0.75) + (x1 * 0.5 + x2 * 0.125)) / 2"),
    "fn_index": ([6, 2, 13, 33], (), (), "(x1 + 2 * x2) / 2"),
    "fn_noise": ([2, 7, 13, 33], [1.0625], (), "(x1 * 1.0625 + x2 * 1.0625) / 2"),
    "fn_literal": ([-3, 2, 13, 33], (), (), "(3 * x1 + 3 * x2) / 2"),
    "fn_add": ([2, 3, 11, 33], (), (), each("({x} + x1)")),
    "fn_subtract": ([2, 3, 12, 33], (), (), each("({x} - x1)")),
    "fn_multiply": ([2, 3, 13, 33], (), (), each("({x} * x1)")),
    "fn_divide": ([2, 3, 14, 33], (), (), each("({x} / x1)")),
    "fn_negative": ([2, 21, 33], (), (), each("(-{x})")),
    "fn_reciprocal": ([2, 2, 13, 1, 11, 22, 33], [1.5], (), each("1 / ({x} * {x} + 1.5)")),
    "fn_times10": ([2, 23, 33], (), (), each("10 * {x}")),
    "fn_square": ([2, 24, 33], (), (), each("{x} * {x}")),
    "fn_sqrt_abs": ([2, 25, 33], (), (), each("sqrt(abs({x}))")),
    "fn_abs": ([2, 26, 33], (), (), each("abs({x})")),
    "fn_round": ([2, 27, 33], (), (), each("round_even({x}, 0)")),
    "fn_sin": ([2, 28, 33], (), (), each(f"sin({TWO_PI} * {{x}})")),
    "fn_cos": ([2, 29, 33], (), (), each(f"cos({TWO_PI} * {{x}})")),
    "fn_log_abs": ([2, 24, 1, 11, 30, 33], [0.5], (), each("ln({x} * {x} + 0.5)")),
    "fn_exp": ([2, 31, 33], (), (), each("exp({x})")),
    "fn_sum": ([2, 32], (), (), "x1 + x2"),
    "fn_mean": ([2, 24, 33], (), (), "(x1 * x1 + x2 * x2) / 2"),
    "fn_cumsum": ([2, 34, 24, 33], (), (), "(x1 * x1 + (x1 + x2) * (x1 + x2)) / 2"),
    "fn_product": ([2, 35], (), (), "x1 * x2"),
    "fn_maximum": ([2, 36], (), (), "greatest(x1, x2)"),
    "fn_collapse": ([2, 3, 13], (), (), each("{x} * x1")),
    "fn_text_precedence": ([2, 3, 11, 2, 13, 33], (), (), each("({x} + x1 * {x})")),
    "fn_text_wave": ([2, 3, 11, 28, 33], (), (), each(f"sin({TWO_PI} * {{x}} + x1)")),
    "fn_text_quotient": ([3, 2, 1, 11, 22, 14, 33], [7.5], (), each("x1 / 1 / ({x} + 7.5)")),
}
for _name, (_rpn, _consts, _rots, _hand) in TOKENS.items():
    add(_name, _expression(_rpn, _consts, _rots), _by_hand(_hand))
add("fn_tree_precedence", _expression([2, 3, 11, 2, 13, 33], semantics="tree"), _by_hand(each("(({x} + x1) * {x})")))


# Tokens made from the parts: those outside the table are named, as the compiler refuses them.
add("fn_unknown_token", lambda spark, sf: v.table(spark, sf, "part").select("p_partkey", F.explode(unknown_tokens(
    F.array(F.col("p_size").cast("int"), (F.col("p_size") - 10).cast("int"), F.lit(33)))).alias("token")),
    """SELECT p_partkey, token FROM (SELECT p_partkey, unnest([p_size, p_size - 10, 33])::INTEGER AS token FROM part)
WHERE NOT (token < 0 OR token BETWEEN 1 AND 7 OR token BETWEEN 11 AND 14 OR token BETWEEN 21 AND 36)""")


@query("fn_ieee", f"""WITH {v.PART_INPUTS} SELECT sample_id, CASE WHEN x1 > 0 THEN 'inf' ELSE '-inf' END AS quotient, 'nan' AS zero_by_zero,
'-inf' AS log_zero, 0.0::DOUBLE AS recovered FROM pts""")
def ieee(spark, sf):
    """Zero divisors and logarithms of zero keep infinities, and come back as valid numbers."""
    prog = Program()
    zero = [3, 3, 12]
    add_expression(prog, X, "quotient", [3, *zero, 14], semantics="tree")
    add_expression(prog, X, "zero_by_zero", [*zero, *zero, 14], semantics="tree")
    add_expression(prog, X, "log_zero", [*zero, 30], semantics="tree")
    add_expression(prog, X, "recovered", [*zero, 22, 22], semantics="tree")
    df = prog.apply(v.part_inputs(spark, sf), ["sample_id"])

    def word(c):
        return F.when(F.isnan(c), "nan").when(col(c) == float("inf"), "inf").when(col(c) == -float("inf"), "-inf")

    return df.select("sample_id", word("quotient").alias("quotient"), word("zero_by_zero").alias("zero_by_zero"),
                     word("log_zero").alias("log_zero"), F.abs("recovered").alias("recovered"))


# ---- a fixed catalogue ---------------------------------------------------------------------------

FIXED = [
    {"name": "rgf1", "rpn": [2, 2, 13, 1, 11, 33], "consts": [2.5], "rots": []},
    {"name": "rgf2", "rpn": [2, 3, 11, 2, 13, 28, 33], "consts": [], "rots": []},
    {"name": "rgf3", "rpn": [5, 24, 1, 11, 30, 33], "consts": [1.25], "rots": TURN},
    {"name": "rgf4", "rpn": [6, 2, 13, 31, 25, 33], "consts": [], "rots": []},
    {"name": "rgf5", "rpn": [4, 2, 12, 29, 23, 2, 11, 33], "consts": [], "rots": []},
    {"name": "rgf6", "rpn": [2, 2, 2, 12, 14, 33], "consts": [], "rots": []},
    {"name": "rgf7", "rpn": [3, 3, 12, 22, 33], "consts": [], "rots": []},
    {"name": "rgf8", "rpn": [1, 33], "consts": [4.0], "rots": []},
]


# The same functions written by hand from the infix texts of the lists.
_TURNED = ("(0.25 * x1 + 0.75 * x2)", "(0.5 * x1 + 0.125 * x2)")
HAND = {
    "rgf1": each("({x} * {x} + 2.5)"),
    "rgf2": each(f"sin({TWO_PI} * {{x}} + x1 * {{x}})"),
    "rgf3": "(" + " + ".join(f"ln(abs({t} * {t} + 1.25))" for t in _TURNED) + ") / 2.0::DOUBLE",
    "rgf4": "(sqrt(abs(exp(x1))) + sqrt(abs(exp(2 * x2)))) / 2.0::DOUBLE",
    "rgf5": f"((10 * cos({TWO_PI} * x2 - x1) + x1) + (10 * cos({TWO_PI} * 0 - x2) + x2)) / 2.0::DOUBLE",
    "rgf6": each("({x} * power({x}, -1) - {x})"),
    "rgf7": "power(x1 - x1, -1)",
    "rgf8": "4.0::DOUBLE",
}


def _fixed_sql(rows):
    cells = [f"CASE WHEN abs({HAND[r['name']]}) < 1e-20 THEN 0 ELSE {HAND[r['name']]} END AS {r['name']}" for r in rows]
    return f"SELECT sample_id, {', '.join(cells)} FROM pts"


FINITE = FIXED[:5]


@query("to_expression", f"WITH {v.PART_INPUTS}, w AS ({_fixed_sql(FINITE)}) SELECT sample_id, label, {v.t('y')} AS y FROM w "
       f"UNPIVOT (y FOR label IN ({', '.join(r['name'] for r in FINITE)}))")
def to_expression(spark, sf):
    wide, names = evaluate.expression_columns(v.part_inputs(spark, sf), X, FINITE, keep=["sample_id"])
    return tables.to_long(wide, names).withColumn("y", tidy("y"))


def _checks(spark, sf):
    wide, names = evaluate.expression_columns(v.part_inputs(spark, sf), X, FIXED, keep=["sample_id"])
    return cat.function_checks(wide, names)


_BAD = "y IS NULL OR isnan(y) OR isinf(y)"
_CHECKS = f"""{v.PART_INPUTS}, w AS ({_fixed_sql(FIXED)}),
l AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (y FOR func IN ({', '.join(r['name'] for r in FIXED)}))),
c AS (SELECT func, count(CASE WHEN {_BAD} THEN 1 END) AS n_bad, var_pop(CASE WHEN NOT ({_BAD}) THEN y END) AS variance FROM l GROUP BY func)"""
add("valid_function_filter", lambda spark, sf: _checks(spark, sf).select("func", "n_bad", F.col("valid").cast("int").alias("valid")),
    f"WITH {_CHECKS} SELECT func, n_bad, CASE WHEN n_bad = 0 AND variance >= 1e-10 THEN 1 ELSE 0 END AS valid FROM c")
add("generation_stats", lambda spark, sf: cat.generation_stats(_checks(spark, sf)),
    f"""WITH {_CHECKS} SELECT count(CASE WHEN n_bad = 0 AND variance >= 1e-10 THEN 1 END) AS valid, count(CASE WHEN n_bad > 0 THEN 1 END) AS not_finite,
count(CASE WHEN n_bad = 0 AND variance < 1e-10 THEN 1 END) AS flat, count(*) AS total,
round(count(CASE WHEN n_bad = 0 AND variance >= 1e-10 THEN 1 END) / count(*)::DOUBLE, 2) AS success_rate FROM c""")


# ---- the random catalogue ---------------------------------------------------------------------------

def _candidates(spark, sf):
    """One candidate function per part."""
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("func_id"))


def _catalogue(spark, sf):
    return cat.generate_catalogue(_candidates(spark, sf), 2, seed=42)


def _flat(df):
    return df.select("func_id", "injection", F.array_join(F.transform("rpn", lambda t: t.cast("string")), " ").alias("rpn"),
                     F.size("consts").alias("n_consts"), F.size("rots").alias("n_rots"), "expr")


add("generate_catalogue", lambda spark, sf: _flat(_catalogue(spark, sf)))
def _draws(what, *ids):
    """The uniform number of a seed, a purpose and ids, in SQL."""
    parts = ", ':', ".join([f"'42:{what}'", *ids])
    return f"(CAST('0x' || substr(md5(concat({parts})), 1, 12) AS BIGINT) / {float(1 << 48)!r}::DOUBLE)"


def _picked(u, tokens, weights):
    """The first token whose cumulative share reaches the number."""
    shares = [f"{c / sum(weights)!r}::DOUBLE" for c in accumulate(weights)]
    return f"({list(tokens)})[1 + len(list_filter([{', '.join(shares)}], lambda c: c < {u}))]"


# Token lists grown leaf by leaf: all weights are powers of one half, so their sums are exact in any order.
_TREES = f"""RECURSIVE g AS (
  SELECT p_partkey AS func_id, 0 AS k, {cat.MIN_STEPS} + CAST(floor({_draws('steps', 'p_partkey')} * {cat.MAX_STEPS - cat.MIN_STEPS + 1}) AS INTEGER) AS steps,
         [2, 33] AS t, [1.0::DOUBLE, 0.0::DOUBLE] AS w FROM part
  UNION ALL
  SELECT func_id, k + 1, steps, list_concat(t[1:pos], CASE WHEN op > 20 THEN [t[pos + 1], op] WHEN side < 0.5 THEN [t[pos + 1], operand, op] ELSE [operand, t[pos + 1], op] END, t[pos + 2:]),
         list_concat(w[1:pos], CASE WHEN op > 20 THEN [w[pos + 1], 0.0::DOUBLE] ELSE [w[pos + 1] / 2, w[pos + 1] / 2, 0.0::DOUBLE] END, w[pos + 2:])
  FROM (SELECT *, len(list_filter(range(1, len(w) + 1), lambda i: list_sum(list_slice(w, 1, i)) <= leaf)) AS pos,
               {_picked('u_op', cat.OPERATORS, cat.OPERATOR_WEIGHTS)} AS op, {_picked('u_operand', cat.OPERANDS, cat.OPERAND_WEIGHTS)} AS operand
        FROM (SELECT *, {_draws('leaf', 'func_id', 'k + 1')} AS leaf, {_draws('operator', 'func_id', 'k + 1')} AS u_op,
                     {_draws('operand', 'func_id', 'k + 1')} AS u_operand, {_draws('side', 'func_id', 'k + 1')} AS side FROM g WHERE k < steps))),
grown AS (SELECT func_id, t AS grown, {_draws('injection', 'func_id')} AS u FROM g WHERE k = steps),
kinds AS (SELECT *, CASE {' '.join(f"WHEN u < {limit!r} THEN '{name}'" for limit, name in cat.INJECTIONS)} ELSE 'none' END AS injection FROM grown),
trees AS (SELECT func_id, injection, grown, CASE injection WHEN 'noise' THEN list_concat(grown, [7, 13]) WHEN 'flat' THEN list_concat(grown, [27])
  WHEN 'multimodal' THEN list_concat(grown, grown, [28, 11]) WHEN 'highly_multimodal' THEN list_concat(grown, grown, [28, 23, 11])
  {' '.join(f"WHEN '{name}' THEN flatten(list_transform(grown, lambda x: CASE WHEN x = 2 THEN {tokens} ELSE [x] END))" for name, tokens in cat.LINKAGE.items())}
  ELSE grown END AS injected FROM kinds)"""

add("token_weights", lambda spark, sf: cat.token_frequencies(cat.generate_trees(_candidates(spark, sf), 42)),
    f"WITH {_TREES} SELECT token, count(*) AS n FROM (SELECT unnest(grown) AS token FROM trees) GROUP BY token")
add("inject_difficulty", lambda spark, sf: cat.generate_trees(_candidates(spark, sf), 42).groupBy("injection")
    .agg(F.count("*").alias("n"), F.avg(F.size("injected") - F.size("grown")).alias("added_tokens")),
    f"WITH {_TREES} SELECT injection, count(*) AS n, avg(len(injected) - len(grown)) AS added_tokens FROM trees GROUP BY injection")
add("inject_linkage", lambda spark, sf: cat.generate_trees(_candidates(spark, sf), 42)
    .where(F.col("injection").startswith("linkage") | (F.col("injection") == "index_scaled"))
    .select("func_id", "injection", F.array_join(F.transform("injected", lambda t: t.cast("string")), " ").alias("rpn")),
    f"WITH {_TREES} SELECT func_id, injection, array_to_string(injected, ' ') AS rpn FROM trees WHERE injection LIKE 'linkage%' OR injection = 'index_scaled'")


def _tokens(column):
    return F.array_join(F.transform(column, lambda t: t.cast("string")), " ")


add("simplified_trees", lambda spark, sf: cat.generate_trees(_candidates(spark, sf), 42)
    .select("func_id", _tokens("injected").alias("before"), _tokens(cat.simplified("injected")).alias("rpn")))


# Token lists over parts, in which every pair of operators of the rewrite rules occurs.
_UNARY_SHAPES = """CASE WHEN p_partkey % 4 = 3 THEN array(2, 3, 11 + p_size % 4, 21 + p_partkey div 4 % 3)
ELSE array(element_at(array(2, 3, 1, 7, -3), cast(p_partkey % 5 + 1 AS INT)), 21 + p_size % 16, cast(21 + p_partkey div 5 % 16 AS INT)) END"""
_LEAF = "element_at(array(1, -2, 2, 3), cast(({}) % 4 + 1 AS INT))"
_SIGN = "element_at(array(array(), array(21), array(22)), cast(({}) % 3 + 1 AS INT))"


add("simplify_unary", lambda spark, sf: v.table(spark, sf, "part").select("p_partkey", F.expr(_UNARY_SHAPES).cast("array<int>").alias("before"))
    .select("p_partkey", _tokens("before").alias("before"), _tokens(cat.fewer_unary("before")).alias("rpn")),
    """WITH t AS (SELECT p_partkey, p_partkey % 4 = 3 AS two, ([2, 3, 1, 7, -3])[p_partkey % 5 + 1] AS leaf, 21 + p_size % 16 AS low,
21 + p_partkey // 5 % 16 AS high, 11 + p_size % 4 AS op, 21 + p_partkey // 4 % 3 AS top FROM part),
u AS (SELECT *, leaf <= 1 OR leaf IN (3, 7) AS plain FROM t),
w AS (SELECT *, CASE WHEN plain AND low >= 32 THEN [leaf] ELSE [leaf, low] END AS inner_list,
      CASE WHEN plain AND low >= 32 THEN leaf ELSE low END AS inner_top, plain OR low IN (32, 33, 35, 36) AS scalar FROM u)
SELECT p_partkey, CASE WHEN two THEN concat_ws(' ', 2, 3, op, top) ELSE concat_ws(' ', leaf, low, high) END AS before, array_to_string(
  CASE WHEN two THEN CASE WHEN (top = 21 AND op = 12) OR (top = 22 AND op = 14) THEN [3, 2, op] ELSE [2, 3, op, top] END
       WHEN scalar AND high >= 32 THEN inner_list
       WHEN high = 26 AND inner_top IN (25, 26, 30) THEN inner_list
       WHEN high IN (25, 26, 30) AND inner_top = 26 THEN [leaf, high]
       WHEN (high = inner_top AND high IN (21, 22)) OR (high, inner_top) IN ((24, 25), (25, 24), (30, 31), (31, 30)) THEN [leaf]
       ELSE list_append(inner_list, high) END, ' ') AS rpn FROM w""")

_BINARY_SHAPES = f"""CASE p_partkey % 3
WHEN 0 THEN concat(array({_LEAF.format('p_size')}), {_SIGN.format('p_partkey div 3')}, array({_LEAF.format('p_partkey div 9')}), {_SIGN.format('p_size div 4')},
                   array(cast(11 + p_partkey div 36 % 4 AS INT)))
WHEN 1 THEN array({_LEAF.format('p_size')}, {_LEAF.format('p_partkey div 3')}, {_LEAF.format('p_partkey div 12')}, cast(11 + p_size div 4 % 4 AS INT),
                  cast(11 + p_partkey div 48 % 4 AS INT))
ELSE array({_LEAF.format('p_size')}, {_LEAF.format('p_size div 4')}, cast(11 + p_partkey div 3 % 4 AS INT), {_LEAF.format('p_partkey div 12')},
           {_LEAF.format('p_partkey div 48')}, cast(11 + p_partkey div 192 % 4 AS INT), cast(11 + p_size div 16 % 4 AS INT)) END"""

add("simplify_binary", lambda spark, sf: v.table(spark, sf, "part").select("p_partkey", F.expr(_BINARY_SHAPES).cast("array<int>").alias("before"))
    .select("p_partkey", _tokens("before").alias("before"), _tokens(cat.fewer_binary("before")).alias("rpn")),
    """WITH leaf AS (SELECT [1, -2, 2, 3] AS l, [[]::INTEGER[], [21], [22]] AS s),
t AS (SELECT p_partkey, p_partkey % 3 AS shape,
      CASE p_partkey % 3 WHEN 0 THEN l[p_size % 4 + 1] WHEN 1 THEN l[p_size % 4 + 1] ELSE l[p_size % 4 + 1] END AS a,
      CASE p_partkey % 3 WHEN 0 THEN l[p_partkey // 9 % 4 + 1] WHEN 1 THEN l[p_partkey // 3 % 4 + 1] ELSE l[p_size // 4 % 4 + 1] END AS b,
      l[p_partkey // 12 % 4 + 1] AS c, l[p_partkey // 48 % 4 + 1] AS d, s[p_partkey // 3 % 3 + 1] AS sign_a, s[p_size // 4 % 3 + 1] AS sign_b,
      CASE p_partkey % 3 WHEN 0 THEN 11 + p_partkey // 36 % 4 WHEN 1 THEN 11 + p_size // 4 % 4 ELSE 11 + p_partkey // 3 % 4 END AS op1,
      CASE p_partkey % 3 WHEN 1 THEN 11 + p_partkey // 48 % 4 ELSE 11 + p_partkey // 192 % 4 END AS op2, 11 + p_size // 16 % 4 AS op3
      FROM part, leaf),
f AS (SELECT *, a <= 1 AS ca, b <= 1 AS cb, c <= 1 AS cc, d <= 1 AS cd, op1 <= 12 AS sum1, op2 <= 12 AS sum2, op3 <= 12 AS sum3,
      CASE op1 WHEN 11 THEN 12 WHEN 12 THEN 11 WHEN 13 THEN 14 ELSE 13 END AS other1 FROM t),
q AS (SELECT *, ca AND cb AS left_fixed, cc AND cd AS right_fixed FROM f)
SELECT p_partkey, array_to_string(CASE shape WHEN 0 THEN list_concat([a], sign_a, [b], sign_b, [op1]) WHEN 1 THEN [a, b, c, op1, op2]
                                  ELSE [a, b, op1, c, d, op2, op3] END, ' ') AS before,
array_to_string(CASE shape
 WHEN 0 THEN CASE WHEN ca AND cb THEN [1]
   WHEN len(sign_b) > 0 THEN CASE WHEN (sign_b[1] = 21) = sum1 THEN list_concat([a], sign_a, [b, other1]) ELSE list_concat([a], sign_a, [b], sign_b, [op1]) END
   WHEN sign_a[1] = 21 AND op1 = 11 THEN [b, a, 12] WHEN sign_a[1] = 22 AND op1 = 13 THEN [b, a, 14]
   ELSE list_concat([a], sign_a, [b], sign_b, [op1]) END
 WHEN 1 THEN CASE WHEN ca AND cb AND cc THEN [1] WHEN cb AND cc THEN [a, 1, op2]
   WHEN ca AND sum1 = sum2 AND cc THEN [a, b, op2]
   WHEN ca AND sum1 = sum2 AND cb THEN [a, c, CASE WHEN op1 = op2 THEN CASE WHEN sum1 THEN 11 ELSE 13 END ELSE CASE WHEN sum1 THEN 12 ELSE 14 END END]
   ELSE [a, b, c, op1, op2] END
 ELSE CASE WHEN left_fixed AND right_fixed THEN [1] WHEN right_fixed THEN [a, b, op1, 1, op3]
   WHEN sum2 = sum3 AND (left_fixed OR (sum1 = sum3 AND (ca OR cb))) AND cd
     THEN list_concat(CASE WHEN left_fixed THEN [1] ELSE [a, b, op1] END, [c, op3])
   WHEN sum2 = sum3 AND (left_fixed OR (sum1 = sum3 AND (ca OR cb))) AND cc
     THEN list_concat(CASE WHEN left_fixed THEN [1] ELSE [a, b, op1] END,
                      [d, CASE WHEN op2 = op3 THEN CASE WHEN sum3 THEN 11 ELSE 13 END ELSE CASE WHEN sum3 THEN 12 ELSE 14 END END])
   ELSE list_concat(CASE WHEN left_fixed THEN [1] ELSE [a, b, op1] END, [c, d, op2, op3]) END END, ' ') AS rpn FROM q""")
add("to_rpn", lambda spark, sf: cat.generate_trees(_candidates(spark, sf), 42)
    .select("func_id", F.array_join(F.transform("grown", lambda t: t.cast("string")), " ").alias("rpn")),
    f"WITH {_TREES} SELECT func_id, array_to_string(grown, ' ') AS rpn FROM trees")


add("random_responses", lambda spark, sf: cat.generate_responses(v.part_inputs(spark, sf), X, 5, seed=42)[1])

# Candidates in an order in which invalid ones come between valid ones.
ORDER = ["rgf8", "rgf3", "rgf7", "rgf1", "rgf5", "rgf2", "rgf4"]
CANDIDATES = [{**next(r for r in FIXED if r["name"] == name), "func_id": k} for k, name in enumerate(ORDER)]
_FIRST = f"""{_CHECKS}, o AS (SELECT func, pos FROM (VALUES {', '.join(f"('{n}', {k})" for k, n in enumerate(ORDER))}) AS o(func, pos)),
f AS (SELECT func, 'rgf' || row_number() OVER (ORDER BY pos) AS label, row_number() OVER (ORDER BY pos) AS place
      FROM c JOIN o USING (func) WHERE n_bad = 0 AND variance >= 1e-10 QUALIFY place <= 4)"""


def _first_four(spark, sf):
    points = v.part_inputs(spark, sf)
    return points, cat.first_valid(points, X, CANDIDATES, 4)[0]


@query("generate_responses", f"WITH {_FIRST} SELECT sample_id, label, {v.t('y')} AS y FROM l JOIN f USING (func)")
def generate_responses(spark, sf):
    points, rows = _first_four(spark, sf)
    return evaluate.expression_rows(points, X, rows).withColumn("y", tidy("y"))


@query("first_n_valid", f"WITH {_FIRST} SELECT label, count(*) AS n, {v.t('var_pop(y)')} AS variance FROM l JOIN f USING (func) GROUP BY label")
def first_n_valid(spark, sf):
    points, rows = _first_four(spark, sf)
    return evaluate.expression_moments(points, X, rows).select(F.col("func").alias("label"), "n", tidy("variance").alias("variance"))


def _stored(spark, sf):
    """The fixed catalogue and its values, written and read back."""
    path = run_path(spark, "catalogue")
    rows = spark.createDataFrame([(r["name"], r["rpn"], r["consts"], r["rots"]) for r in FINITE],
                                 "name string, rpn array<int>, consts array<double>, rots array<array<array<double>>>")
    store.write_catalogue(rows, to_expression(spark, sf), path)
    return store.read_catalogue(spark, path)


def _values_sql(names):
    return (f"WITH {v.PART_INPUTS}, w AS ({_fixed_sql(FINITE)}) SELECT sample_id, label, {v.t('y')} AS y FROM w "
            f"UNPIVOT (y FOR label IN ({', '.join(names)}))")


add("write_catalogue", lambda spark, sf: _stored(spark, sf)[1], _values_sql([r["name"] for r in FINITE]))
add("export_expression", lambda spark, sf: cat.evaluate_by_id(v.part_inputs(spark, sf), X, _stored(spark, sf)[0], ["rgf1", "rgf3"])
    .withColumn("y", tidy("y")), _values_sql(["rgf1", "rgf3"]))


@query("evaluate_by_name", f"WITH {v.PART_INPUTS}, w AS ({_fixed_sql(FINITE)}) SELECT sample_id, label, {v.t('y')} AS y FROM w "
       "UNPIVOT (y FOR label IN (rgf2, rgf4))")
def evaluate_by_name(spark, sf):
    stored = spark.createDataFrame([(r["name"], r["rpn"], r["consts"], r["rots"]) for r in FINITE],
                                   "name string, rpn array<int>, consts array<double>, rots array<array<array<double>>>")
    return cat.evaluate_by_id(v.part_inputs(spark, sf), X, stored, ["rgf2", "rgf4"]).withColumn("y", tidy("y"))


# ---- benchmark functions ------------------------------------------------------------------------------

def _benchmark(fid):
    def run(spark, sf):
        wide, names = evaluate.benchmark_columns(v.part_inputs(spark, sf), X, [(fid, 1), (fid, 2)], keep=["sample_id"])
        return tables.to_long(wide, names).withColumn("y", single("y"))
    return run


def _benchmark_sql(functions, x, source="pts"):
    prog = Program(DUCKDB)
    names = [benchmarks.add_function(prog, x, f, i) for f, i in functions]
    return f"SELECT sample_id, label, {v.f('y')} AS y FROM ({prog.sql(source, ['sample_id'])}) UNPIVOT (y FOR label IN ({', '.join(names)}))"


for _fid in benchmarks.FIDS:
    add(f"bbob_f{_fid}", _benchmark(_fid), f"WITH {v.PART_INPUTS} {_benchmark_sql([(_fid, 1), (_fid, 2)], X)}")

X3 = ["x1", "x2", "x3"]
ALL = [(f, 1) for f in benchmarks.FIDS]


def line_points(spark, sf):
    from fellscape.operators.rescale import Bounds, rescale_affine

    return rescale_affine(v.doe_lineitem(spark, sf).select("sample_id", *X3), v.LINE_BOUNDS, Bounds.cube(X3))


add("apply_functions_to_points", lambda spark, sf: evaluate.apply_functions(spread(line_points(spark, sf), "sample_id"), X3, ALL)  # one file, much work a row
    .groupBy("label").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.avg("y").alias("mean"), F.max("y").alias("hi"))
    .select("label", "n", *[single(c).alias(c) for c in ("lo", "mean", "hi")]),
    f"""WITH {v.DOE_LINEITEM}, pts AS (SELECT sample_id, (x1 - 1.0::DOUBLE) / 49.0::DOUBLE * 10 - 5 AS x1,
x2 / 0.1::DOUBLE * 10 - 5 AS x2, x3 / 0.08::DOUBLE * 10 - 5 AS x3 FROM line),
w AS ({(lambda prog: ([benchmarks.add_function(prog, X3, f, i) for f, i in ALL], prog.sql("pts", ["sample_id"]))[1])(Program(DUCKDB))}),
l AS (SELECT label, y FROM w UNPIVOT (y FOR label IN ({', '.join(f'bbob_f{f}_ins1' for f in benchmarks.FIDS)})))
SELECT label, count(*) AS n, {v.f('min(y)')} AS lo, {v.f('avg(y)')} AS mean, {v.f('max(y)')} AS hi FROM l GROUP BY label""")


# ---- user functions ---------------------------------------------------------------------------------------

add("map_function", lambda spark, sf: evaluate.map_function(
    v.part_inputs(spark, sf), X, lambda p: p[:, 0] ** 2 + 3 * p[:, 1], vectorized=True).select("sample_id", tidy("y").alias("y")),
    f"WITH {v.PART_INPUTS} SELECT sample_id, {v.t('x1 * x1 + 3 * x2')} AS y FROM pts")


@query("apply_per_label", f"""SELECT event_type, count(*) AS n, {v.t('sum(value * value) / count(*)', 4)} AS mean_square FROM events GROUP BY event_type""")
def apply_per_label(spark, sf):
    import pandas as pd

    def partial(pdf):
        return pd.DataFrame({"n": [len(pdf)], "s": [float((pdf["value"] ** 2).sum())]})

    def merge(pdf):
        return pd.DataFrame({"n": [int(pdf["n"].sum())], "mean_square": [pdf["s"].sum() / pdf["n"].sum()]})

    events = v.table(spark, sf, "events").select("event_type", "event_id", "value")
    out = evaluate.apply_per_label(events, ["event_type"], partial, merge, "n long, s double",
                                   "n long, mean_square double", id_col="event_id")
    return out.withColumn("mean_square", tidy("mean_square", 4))
