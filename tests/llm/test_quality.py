import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fellscape.llm import quality


def brute(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\v\f"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(seen) + dup


@pytest.mark.parametrize("text", [None, "", "  \n", "a b c a b c", "a a a a a", "x y z\nx y z\n\nx y z ü", "a# b*|\u00a0c <d>\u2003e", "\ufffd é 𝄞 a"])
def test_measures(text):
    assert quality.measures(None if text is None else text.encode()) == brute(text)


def test_binomial_tail_is_exact():
    for k, n, p in ((0, 50, 0.01), (3, 400, 0.02), (7, 200, 0.1), (100, 5000, 0.03)):
        want = float(sum(math.comb(n, j) * Fraction(p) ** j * (1 - Fraction(p)) ** (n - j) for j in range(k + 1)))
        assert math.exp(quality.log_binomial_tail(k, n, p)) == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_the_limit(spark):
    """Junk with many symbols goes where labels suffice, nothing goes in a stratum with few labels."""
    rows = [(i, "en" if i % 10 else "xx", (" ".join(f"w{i}x{k}{'###' if i % 7 == 0 else ''}" for k in range(60)))) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1).alias("quality"))
    out = quality.judge(docs, labels).groupBy("stratum", (F.col("doc_id") % 7 == 0).alias("junk"), "kept").count().collect()
    got = {(r["stratum"], r["junk"], r["kept"]) for r in out}
    assert got == {("en", True, False), ("en", False, True), ("xx", True, True), ("xx", False, True)}


def test_proven_needs_enough_evidence():
    assert not quality.proven(0, 100, 0.01, 0.05) and quality.proven(0, 400, 0.01, 0.05) and not quality.proven(4, 400, 0.01, 0.05)


def test_messy(spark, messy, labels, nothing):
    out = quality.judge(messy, labels)
    rows = out.collect()
    assert len(rows) == messy.count()
    texts = Counter((r["doc_id"], brute(r["text"])[:5]) for r in messy.collect())
    assert Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows) == texts
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    kept = quality.keep_good(messy, labels)
    assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.judge(messy, labels.limit(0)).where("kept").count() == sum(not r["base_failed"] for r in rows)
    assert quality.judge(nothing, labels).count() == 0 and quality.keep_good(nothing, labels).count() == 0
