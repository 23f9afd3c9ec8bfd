"""Queries of subsamples and designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellscape.functions.columns import tidy
from fellscape.operators import design, sample
from fellscape.operators.rescale import Bounds
from fellscape.queries import views as v
from fellscape.queries.registry import add, query
from fellscape.session import cut, spread

NAMES = ["x1", "x2", "x3"]
UNIT = "/ 281474976710656.0::DOUBLE"


def unit_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) {UNIT})"


def _lines(spark, sf):
    return v.doe_lineitem(spark, sf).select("sample_id", "y1")


add("subsample", lambda spark, sf: sample.subsample(cut(spread(_lines(spark, sf), "sample_id")), "sample_id", 0.8, 2, 42).select("rep", "sample_id", "y1"),
    f"""WITH {v.DOE_LINEITEM}, h AS (SELECT rep, sample_id, y1, md5(concat(42 + rep, ':', sample_id)) AS h, count(*) OVER (PARTITION BY rep) AS n
FROM line, (SELECT unnest([0, 1])::INTEGER AS rep))
SELECT rep, sample_id, y1 FROM h QUALIFY row_number() OVER (PARTITION BY rep ORDER BY h, sample_id) <= ceil(n * 0.8::DOUBLE)""")
add("full_sample", lambda spark, sf: sample.full_sample(_lines(spark, sf)),
    f"WITH {v.DOE_LINEITEM} SELECT 0 AS rep, sample_id, y1 FROM line")
add("expected_sample_size", lambda spark, sf: v.table(spark, sf, "events").groupBy("event_type")
    .agg(sample.expected_sample_size(F.count("*"), 0.8).alias("k")),
    "SELECT event_type, CAST(ceil(count(*) * 0.8::DOUBLE) AS BIGINT) AS k FROM events GROUP BY event_type")


add("subsample_checks", lambda spark, sf: v.table(spark, sf, "lineitem")
    .select((F.col("l_discount") * 20 - 0.5).alias("ratio"), (F.col("l_linenumber") - 2).cast("long").alias("repeats"))
    .withColumn("refused", sample.refused(F.col("ratio"), F.col("repeats"))).groupBy("refused").agg(F.count("*").alias("n")),
    """SELECT NOT (l_discount * 20 - 0.5::DOUBLE > 0 AND l_discount * 20 - 0.5::DOUBLE < 1 AND l_linenumber - 2 > 0) AS refused, count(*) AS n
FROM lineitem GROUP BY 1""")


def _ids(spark, sf):
    """One design point per part; part keys count from 0."""
    ids = v.table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"))
    return ids, ids.count()


def _unit(method):
    def run(spark, sf):
        ids, n = _ids(spark, sf)
        return (design.unit_design(ids, "sample_id", method, NAMES, n, seed=7)
                .select("sample_id", *[tidy(c, 9).alias(c) for c in NAMES]))
    return run


def sobol_sql(dim: int, bits: int) -> str:
    """XOR over 48 bits; points below the bit limit agree with any wider table."""
    terms = [f"(CASE WHEN (g >> {k}) & 1 = 1 THEN {d} ELSE 0 END)::BIGINT" for k, d in enumerate(design.direction_numbers(dim, bits))]
    text = terms[0]
    for term in terms[1:]:
        text = f"xor({text}, {term})"
    return f"{text} / {float(1 << bits)!r}::DOUBLE"


def halton_sql(base: int) -> str:
    terms, power = [], 1
    while power < 10 ** 7:
        terms.append(f"((i // {power}) % {base}) / {float(power * base)!r}::DOUBLE")
        power *= base
    return " + ".join(terms)


add("doe_random", _unit("random"),
    "SELECT p_partkey AS sample_id, " + ", ".join(
        f"{v.t(unit_sql(f'concat(7, chr(58), {j}, chr(58), p_partkey)'), 9)} AS {c}" for j, c in enumerate(NAMES)) + " FROM part")
add("doe_sobol", _unit("sobol"),
    "SELECT sample_id, " + ", ".join(f"{v.t(sobol_sql(j, 24), 9)} AS {c}" for j, c in enumerate(NAMES))
    + " FROM (SELECT p_partkey AS sample_id, xor(p_partkey, p_partkey >> 1) AS g FROM part)")
add("doe_halton", _unit("halton"),
    "SELECT sample_id, " + ", ".join(f"{v.t(halton_sql(b), 9)} AS {c}" for b, c in zip((2, 3, 5), NAMES))
    + " FROM (SELECT p_partkey AS sample_id, p_partkey AS i FROM part)")
_LHS = ", ".join(
    f"((row_number() OVER (ORDER BY md5(concat('perm7:{j}:', p_partkey)), p_partkey) - 1) "
    f"+ {unit_sql(f'concat(7, chr(58), {j}, chr(58), p_partkey)')}) / (SELECT count(*) FROM part)::DOUBLE AS {c}"
    for j, c in enumerate(NAMES))
add("doe_lhs", _unit("lhs"),
    f"WITH d AS (SELECT p_partkey AS sample_id, {_LHS} FROM part) SELECT sample_id, {v.r(NAMES, 9)} FROM d")


def _scaled(spark, sf):
    ids, n = _ids(spark, sf)
    return design.doe_scale(design.unit_design(ids, "sample_id", "halton", NAMES, n),
                            Bounds(("x1", "x2", "x3"), (-5.0, 0.0, 10.0), (5.0, 2.0, 40.0)))


_HALTON_SCALED = ("SELECT p_partkey AS sample_id, " + ", ".join(
    f"({halton_sql(b)}) * {hi - lo}::DOUBLE + {lo}::DOUBLE AS {c}"
    for b, c, lo, hi in zip((2, 3, 5), NAMES, (-5.0, 0.0, 10.0), (5.0, 2.0, 40.0))) + " FROM (SELECT *, p_partkey AS i FROM part)")
add("doe_scale", lambda spark, sf: _scaled(spark, sf).select("sample_id", *[tidy(c, 9).alias(c) for c in NAMES]),
    f"WITH d AS ({_HALTON_SCALED}) SELECT sample_id, {v.r(NAMES, 9)} FROM d")
add("doe_round", lambda spark, sf: design.doe_round(_scaled(spark, sf), NAMES, 2),
    f"WITH d AS ({_HALTON_SCALED}) SELECT sample_id, "
    + ", ".join(f"round_even({c} * 100, 0) / 100 AS {c}" for c in NAMES) + " FROM d")


@query("doe_create", f"WITH d AS ({_HALTON_SCALED}) SELECT sample_id, {v.r(NAMES, 9)} FROM d")
def doe_create(spark, sf):
    ids, n = _ids(spark, sf)
    made = design.doe_create(spark, "halton", n, [-5.0, 0.0, 10.0], [5.0, 2.0, 40.0], ids=ids)
    return made.select("sample_id", *[tidy(c, 9).alias(c) for c in NAMES])
