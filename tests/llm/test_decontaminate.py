import random

import numpy as np
import pytest

import __spark_entry__ as entry
from fellscape.llm import decontaminate as d

QUESTION = "If Tom has 5 apples and Mary has 7 apples then how many apples does Tom have after Mary gives 3 km away?"
OTHER = "If Bob has 50 apples and Sue has 71 apples then how many apples does Bob have after Sue gives 9 miles away?"
TWISTED = "If Bob has 50 apples and Sue has 71 apples then how many apples does Ann have after Liz gives 9 miles away?"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_templates(spark):
    docs = docs_of(spark, [f"Well. {QUESTION} Fine.", OTHER, TWISTED, None, "", QUESTION.lower().replace(",", ""), "Nothing like it at all, really nothing."])
    got = {r["doc_id"]: r["kind"] for r in d.leaks(docs, items_of(spark, [QUESTION, None, "two words"])).collect()}
    assert got[0] == "exact" and got[1] == "reparameterised" and 2 not in got and not {3, 4, 6} & set(got)


def test_query_against_brute_force(spark, sf):
    """Whole items in documents are found; documents that share no run of eight words with any item are left alone."""
    plain = lambda t: [w for w in (x.strip(".,!?") for x in (t or "").lower().split()) if any(c.isalnum() for c in w)]
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op6_template_decontamination"](spark, sf).collect()}
    runs = {i: {tuple(w[k:k + 8]) for k in range(len(w) - 7)} for i, w in items.items()}
    for doc, words in docs.items():
        own = {tuple(words[k:k + 8]) for k in range(len(words) - 7)}
        for item, want in runs.items():
            if want and want <= own:
                assert (doc, item) in found
            if not want & own:
                assert (doc, item) not in found
    assert found


def test_windows_by_hand():
    """Hashes agree exactly where template windows agree."""
    rng = random.Random(2)
    vocabulary = ["the", "red", "5", "17", "km", "Paris", "and", "house", "|", "goes", "to."]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)).encode() for _ in range(20)]
    t = d.tokens(texts, d.Codes())
    at, h = d.window_hashes(t, 8)
    template = [("n", int(k)) if k else w.strip(".").lower() for k, w in zip(t.kind, t.word)]
    windows = [tuple(template[i:i + 8]) for i in at]
    assert len(set(windows)) == len(set(h.tolist())) and len(set(zip(windows, h.tolist()))) == len(set(windows))
    assert all(t.owner[i] == t.owner[i + 7] and sum(k == 0 for k in t.kind[i:i + 8]) >= d.MIN_LITERALS for i in at)


def test_short_items_and_ties(spark):
    docs = docs_of(spark, ["a short item here now", "x y z a short item here now a short item here now", "short item"])
    items = items_of(spark, ["a short item here", "a short item here", "one two", ""])
    got = sorted((r["doc_id"], r["item_id"], r["matched"]) for r in d.leaks(docs, items).collect())
    assert got == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1)]


def test_messy(spark, messy, nothing):
    source = [r["text"] for r in messy.collect()]
    items = items_of(spark, [source[0], source[63], None, ""]).withColumnRenamed("item_id", "item_id")
    kept = d.clean(messy, items)
    found = {r["doc_id"] for r in d.leaks(messy, items).collect()}
    assert 0 in found and kept.columns == messy.columns and kept.count() == sum(r["doc_id"] not in found for r in messy.collect())
    none = items.limit(0)
    assert d.leaks(messy, none).count() == 0 and d.clean(messy, none).count() == messy.count()
    assert d.leaks(nothing, items).count() == 0 and d.clean(nothing, items).count() == 0


def test_bit_table_has_every_hash(spark):
    theirs = d.item_windows(items_of(spark, [QUESTION, OTHER]))
    table = d.bit_table(theirs, theirs.count())
    shift = 64 - (len(table) * 8).bit_length() + 1
    lead = np.array([r["hash"] for r in theirs.collect()], np.int64).view(np.uint64) >> np.uint64(shift)
    assert all(table[int(x) >> 3] >> (int(x) & 7) & 1 for x in lead) and pytest.approx(len(table)) == 1 << (64 - shift - 3)
