"""Quality rules whose cutoffs carry a proven limit on false rejection.

A rule rejects documents whose measure lies at or beyond a cutoff.  Cutoffs come from a fixed
ladder, loosest first.  Within a stratum (a language, say) every rung is tested on the labelled
good documents: with ``k`` of ``n`` rejected, the hypothesis "the rung rejects more than
``alpha`` of the good documents" is refuted when ``P(Bin(n, alpha) <= k)`` is at most
``delta / families``.  A family is one rule in one stratum.  Its rungs are tested in their
fixed order and testing stops at the first that is not refuted, which needs no further
correction; the families share ``delta`` (Bonferroni).  ``alpha`` is the stratum's limit divided
by the number of rules, so that all rules together keep it.  With probability ``1 - delta`` every
stratum then loses at most ``max_false_rejection`` of its good documents.

Among proven rungs the one that rejects most labelled bad documents is taken, the loosest of
equals; a rule that catches none, or has no proven rung, rejects nothing in that stratum.

NULL and empty texts have no words and fail the base rules; a NULL stratum is one of its own.  Texts are taken whole, however
long.  Repeated rows get a row each.  An empty table gives an empty result, and without labels only the base rules reject.  Columns of
``docs`` that are named like a count keep their values (``keep_good`` works under fresh names).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fellscape.llm.common import binary_rows, broadcast_if_small, fresh, in_batches
from fellscape.session import cut

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
BATCH_BYTES = 8 << 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """A measure ``numerator / denominator`` with its ladder of cutoffs, loosest first."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[float, ...]
    above: bool = True

    def measure(self) -> Column:
        """NULL where the denominator is zero: such a document breaks no rule."""
        return F.when(F.col(self.denominator) > 0, F.col(self.numerator) / F.col(self.denominator))

    def broken(self, cutoff: Column) -> Column:
        m = self.measure()
        return F.coalesce(m >= cutoff if self.above else m <= cutoff, F.lit(False))


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    Rule("repeats", "n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    Rule("lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("long", "word_chars", "n_words", (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    Rule("short", "word_chars", "n_words", (1.5, 2.0, 2.5, 3.0, 3.5), above=False),
)


@dataclass(frozen=True)
class Risk:
    max_false_rejection: float = 0.02
    delta: float = 0.05


def measures(text: bytes | None) -> tuple[int, ...]:
    """The counts named by :data:`STATS` of one whole text."""
    if text is None:
        return (0,) * len(STATS)
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (len(words), len(joined.decode("utf-8", "replace")), len(joined) - len(joined.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(lines))


def with_measures(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` (or its columns ``keep``) with the counts of :data:`STATS`; also their column names."""
    kept = list(docs.columns if keep is None else keep)
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    names = fresh(source, *STATS)
    (raw,) = fresh(source, "raw_text")
    schema = T.StructType([*source.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in binary_rows(batches, raw, BATCH_BYTES):
            rows = [measures(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], names=[*kept, *names])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(raw))
    return in_batches(source).mapInArrow(run, schema), names


def base_failed() -> Column:
    """The two fixed rules."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(Bin(n, p) <= k), exact up to rounding."""
    if k >= n:
        return 0.0
    term = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    top = term(min(k, int((n + 1) * p)))
    total = 0.0
    for j in range(k, -1, -1):  # terms fall on both sides of the mode
        t = term(j) - top
        total += math.exp(t)
        if t < -40 and j < n * p:
            break
    return min(0.0, top + math.log(total))


def proven(k: int, n: int, alpha: float, level: float) -> bool:
    """Do ``k`` false rejections among ``n`` good documents refute a rate above ``alpha``?"""
    if k >= alpha * n:
        return False
    return log_binomial_tail(k, n, alpha) <= math.log(level)


def cutoffs(measured: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, risk: Risk = Risk()) -> DataFrame:
    """One row per stratum and rule: ``stratum, rule, cutoff`` (NULL: reject nothing), with its evidence.

    ``measured`` has ``doc_id, stratum, base_failed`` and the counts; ``labels`` has ``doc_id,
    quality``.  A document labelled several times counts once and is good only if every label
    says so; labels other than 0 and 1 and rows without an id are left out.
    """
    verdict = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
               .groupBy("doc_id").agg(F.min("quality").alias("good")))
    rungs = [F.sum(F.when((F.col("good") == good) & r.broken(F.lit(c)), 1).otherwise(0)).alias(f"{r.name}_{i}_{good}")
             for r in rules for i, c in enumerate(r.cutoffs) for good in (0, 1)]
    counts = (measured.where(~F.col("base_failed")).join(verdict, "doc_id").groupBy("stratum")
              .agg(F.sum("good").alias("n_good"), *rungs))
    counts = cut(counts)
    families = max(1, counts.count()) * len(rules)
    alpha, level = risk.max_false_rejection / len(rules), risk.delta / families
    schema = "stratum string, rule string, cutoff double, n_good long, false_rejections long, caught long"

    def choose(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for rule in rules:
                    best = (None, None, 0)
                    for i, c in enumerate(rule.cutoffs):
                        bad, wrong = row[f"{rule.name}_{i}_0"], row[f"{rule.name}_{i}_1"]
                        if not proven(wrong, row["n_good"], alpha, level):
                            break
                        if bad > best[2]:
                            best = (c, wrong, bad)
                    out.append((row["stratum"], rule.name, best[0], row["n_good"], best[1], best[2]))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return counts.mapInArrow(choose, schema)


def wide(found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per stratum with a column ``cutoff_<rule>``."""
    return found.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cutoff_{r.name}") for r in rules])


def broken_rules(rules: Sequence[Rule] = RULES) -> Column:
    """Names of the rules that a measured row breaks; strata without cutoffs break none."""
    return F.filter(F.array(*[F.when(F.col(f"cutoff_{r.name}").isNotNull() & r.broken(F.col(f"cutoff_{r.name}")), F.lit(r.name))
                              for r in rules]), lambda x: x.isNotNull())


def stratum_of(column: str) -> Column:
    """NULL is a stratum of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("(none)"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: Sequence[Rule] = RULES, risk: Risk = Risk()) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``broken`` (rule names) and ``kept``, one row per row of ``docs``.

    NULL texts have no words and fail the base rules.  Without labels no rung is proven, so only
    the base rules reject.  Repeated rows get a row each.
    """
    thin = docs.select("doc_id", stratum_of(stratum).alias("stratum"), "text")
    measured, _ = with_measures(thin, keep=["doc_id", "stratum"])
    measured = cut(measured.withColumn("base_failed", base_failed()))
    found = cut(wide(cutoffs(measured, labels, rules, risk), rules))
    return (measured.join(broadcast_if_small(found), "stratum", "left").withColumn("broken", broken_rules(rules))
            .select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "stratum", "broken"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: Sequence[Rule] = RULES, risk: Risk = Risk()) -> DataFrame:
    """The documents that pass, whole, with their own columns in their order; texts are not shuffled."""
    thin = docs.select("doc_id", stratum_of(stratum).alias("stratum"), "text")
    measured, _ = with_measures(thin, keep=["doc_id", "stratum"])  # of all documents: labels meet counts, not texts
    found = cut(wide(cutoffs(cut(measured.withColumn("base_failed", base_failed())), labels, rules, risk), rules))
    found = broadcast_if_small(found)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                      stratum_of(stratum).alias("stratum"), "text")
    rows, _ = with_measures(own, keep=["doc", "stratum"])
    return (rows.where(~base_failed()).join(found, "stratum", "left").where(F.size(broken_rules(rules)) == 0)
            .select(*[F.col("doc").getField(c).alias(c) for c in docs.columns]))


def sql(rules: Sequence[Rule] = RULES, risk: Risk = Risk()) -> str:
    """The same judgement in SQL, for comparison: counts from word lists, tails as sums of binomial terms."""
    rungs = ", ".join(f"({k}, '{r.name}', {i}, {c!r}::DOUBLE, {str(r.above).lower()})" for k, r in enumerate(rules) for i, c in enumerate(r.cutoffs))
    measured = ", ".join(f"{{'k': {k}, 'v': {r.numerator} / nullif({r.denominator}, 0)::DOUBLE}}" for k, r in enumerate(rules))
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{word}+') AS words FROM documents),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
h AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM w),
m AS (SELECT w.rid, doc_id, stratum, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: len(x))), 0)::BIGINT AS word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w JOIN l USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
y AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
x AS (SELECT rid, unnest([{measured}], recursive := true) FROM b),
r AS (SELECT * FROM (VALUES {rungs}) AS v(k, rule, rung, cutoff, above)),
n AS (SELECT stratum, sum(good) AS n_good, count(*) OVER () * {len(rules)} AS families FROM b JOIN y USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
t AS (SELECT b.stratum, r.k, rung, cutoff, above,
             sum(CASE WHEN good = 0 AND coalesce(CASE WHEN above THEN v >= cutoff ELSE v <= cutoff END, false) THEN 1 ELSE 0 END) AS bad,
             sum(CASE WHEN good = 1 AND coalesce(CASE WHEN above THEN v >= cutoff ELSE v <= cutoff END, false) THEN 1 ELSE 0 END) AS wrong
      FROM b JOIN y USING (doc_id) JOIN x USING (rid) JOIN r USING (k) WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT t.*, n_good, families, wrong < {risk.max_false_rejection / len(rules)!r} * n_good AND ln((SELECT sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1)
             + j * ln({risk.max_false_rejection / len(rules)!r}::DOUBLE) + (n_good - j) * ln(1 - {risk.max_false_rejection / len(rules)!r}::DOUBLE))) FROM range(wrong::BIGINT + 1) AS q(j)))
             <= ln({risk.delta!r}::DOUBLE / families) AS proven FROM t JOIN n USING (stratum)),
f AS (SELECT * FROM p QUALIFY bool_and(proven) OVER (PARTITION BY stratum, k ORDER BY rung)),
z AS (SELECT stratum, k, cutoff, above FROM f WHERE bad > 0 QUALIFY row_number() OVER (PARTITION BY stratum, k ORDER BY bad DESC, rung) = 1),
e AS (SELECT b.rid, string_agg(rule, ',' ORDER BY z.k) AS broken FROM b JOIN z USING (stratum) JOIN x ON x.rid = b.rid AND x.k = z.k
      JOIN (SELECT DISTINCT k, rule FROM r) AS names ON names.k = z.k WHERE CASE WHEN above THEN v >= cutoff ELSE v <= cutoff END GROUP BY b.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken IS NULL AS kept, stratum, coalesce(broken, '') AS broken
FROM b LEFT JOIN e USING (rid)"""
