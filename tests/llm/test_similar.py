"""Groups of near copies by five-word shingles against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fellscape.llm import similar, simhash

from .conftest import DOCS, words


def brute_shingles(text):
    w = (text or "").lower().split()
    size = min(5, len(w))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()


def brute_components(texts):
    """Smallest id of the linked group of each id; ``texts`` maps ids to texts."""
    ids, label = sorted(texts), {i: i for i in texts}
    own = {i: brute_shingles(texts[i]) for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if own[a] == own[b] or len(own[a] & own[b]) * 5 >= len(own[a] | own[b]) * 4:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k:k + 1] = rng.choice(([f"e{rng.randrange(10**6)}"], [], [w[k], "added"]))
    return " ".join(w)


def test_against_all_pairs(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.choice([3, 6, 30, 120, 400])) for _ in range(60)] + ["", None, " ", "One", "one"]
    for _ in range(150):  # copies of copies, so that groups are chains; many lie just under or over the limit
        base = rng.choice([t for t in texts if t and len(t.split()) > 20])
        texts.append(edited(rng, base, rng.randrange(0, max(2, len(base.split()) // 25))))
    common = words(rng, 60)
    texts += [f"{common} {words(rng, rng.randrange(5, 60))}" for _ in range(40)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(docs).collect()}
    want = brute_components(dict(enumerate(texts)))
    assert all(want[i] == want[got[i]] for i in got)  # no wrong link
    own = {frozenset(brute_shingles(t)): i for i, t in enumerate(texts)}
    links = [(i, j) for a, i in own.items() for b, j in own.items() if i < j and len(a & b) * 5 >= len(a | b) * 4]
    assert sum(got[i] == got[j] for i, j in links) >= 0.98 * len(links) > 60
    assert 20 < len(set(got.values())) < len(texts) - 40


def test_stage_removes_copies_with_a_few_edits(spark):
    """Copies of 150 words with three edits differ in more than two bits of a fingerprint."""
    rng = random.Random(13)
    bases = [words(rng, 150, 5000) for _ in range(30)]
    texts = [*bases, *[edited(rng, t, 3) for t in bases]]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    want = {i for i, k in brute_components(dict(enumerate(texts))).items() if i == k}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want and len(want) < 40


def test_links_of_the_given_documents(spark):
    """Of all pairs of similarity 0.8 in a larger table at least 98 in 100 are in one group, and no others are linked."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(docs).collect()}
    own = {r["doc_id"]: brute_shingles(r["text"]) for r in docs.collect()}
    held, links = {}, set()
    for i in sorted(own):
        for x in own[i]:
            held.setdefault(x, []).append(i)
    for group in held.values():
        links |= {(group[0], i) for i in group[1:]} | {(i, j) for i in group[:40] for j in group[:40] if i < j}
    links = [(a, b) for a, b in links if len(own[a] & own[b]) * 5 >= len(own[a] | own[b]) * 4]
    assert sum(got[a] == got[b] for a, b in links) >= 0.98 * len(links) > 100
    for i, k in got.items():
        assert k == i or got[k] == k


def test_references_cover_a_large_group(spark, monkeypatch):
    """A group far larger than a chunk proposes about one pair a node and bucket, not all pairs."""
    monkeypatch.setattr(similar, "CHUNK", 16)
    rng = random.Random(14)
    base = words(rng, 300, 5000)
    texts = [edited(rng, base, 1) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in similar.groups(docs).collect()} == {0}
    codes = similar.Codes()
    sets = [similar.shingles(t.encode(), codes) for t in texts]
    nodes = spark.createDataFrame([(k, len(x), bytearray(similar.fingerprint(x))) for k, x in enumerate(sets)], "node long, n int, fp binary")
    assert similar.proposed(nodes, False).count() < 0.3 * 400 * 399 / 2


def test_copies_linked_through_their_original_only(spark, monkeypatch):
    """Copies of one text that are not similar enough to each other: all are found, with few pairs."""
    rng = random.Random(16)
    base = words(rng, 200, 5000)
    texts = [base, *(edited(rng, base, 4) for _ in range(300))]
    rng.shuffle(texts)
    want = brute_components(dict(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, real = [], similar.proposed
    monkeypatch.setattr(similar, "proposed", lambda *a: pairs.append(real(*a)) or pairs[-1])
    counts = []
    real_verified = similar.verified
    monkeypatch.setattr(similar, "verified", lambda p, *a: counts.append(p.count()) or real_verified(p, *a))
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(docs).collect()}
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(got) and len(set(want.values())) < 30
    assert sum(counts) < 0.35 * 301 * 300 / 2


def test_messy(spark, messy, nothing):
    kept = similar.one_of_each(messy.withColumn("gone_id", F.lit(1)))
    assert kept.columns == [*messy.columns, "gone_id"]
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    every = [(r["doc_id"], r["text"]) for r in messy.collect()]
    # one row of each distinct text, the one with the smallest id; ids of NULL last
    first = {}
    for i, t in sorted(every, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(frozenset(brute_shingles(t)), i)
    assert sorted(map(str, rows)) == sorted(str((i, t)) for i, t in dict.fromkeys(every) if first[frozenset(brute_shingles(t))] == i)
    assert (65, every[4][1]) not in rows and sum(i == 65 for i, _ in rows) == 1 and sum(i is None for i, _ in rows) == 1
    assert similar.one_of_each(nothing).count() == 0 and similar.groups(nothing).count() == 0


def test_rows_that_share_an_id(spark):
    """Two texts under one id are two documents; of equal rows one stays, whatever their order."""
    rng = random.Random(15)
    a, b = words(rng, 90), words(rng, 90)
    rows = [(4, a, "x"), (65, a, "x"), (65, b, "x"), (65, b, "w"), (None, b, "x"), (None, "alone", "x"), (None, "alone", "x")]
    for order in (rows, rows[::-1]):
        got = similar.one_of_each(spark.createDataFrame(order, "doc_id long, text string, lang string")).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(4, a, "x"), (65, b, "w"), (None, "alone", "x")], key=str)


def test_no_link_at_the_limit_is_lost(spark):
    """Short texts of four and five shingles, four of them shared: similarity exactly 0.8, and every link is found."""
    rng = random.Random(17)
    bases = [words(rng, 8, 10**6) for _ in range(1500)]
    texts = [*bases, *(f"{t} more" for t in bases)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.groups(docs).collect()}
    assert got == {i: i % 1500 for i in range(3000)}


def test_table_of_distances():
    """Coordinates are distances to the references of operator 3; near copies share a filed key, whatever is common."""
    rng = np.random.default_rng(18)
    items = np.unique(rng.integers(0, 1 << 64, 700, dtype=np.uint64))
    prints = similar.simhashes(items, np.array([0, 1, 5, 300]))
    for print_, own in zip(prints, np.split(items, [1, 5, 300])):
        assert all((int(print_) >> k & 1) == (2 * sum(int(x) >> k & 1 for x in own) > len(own)) for k in range(64))
    table = similar.distances(prints)
    assert table.tolist() == [[(int(p) ^ int(r)).bit_count() for r in simhash.references()[:similar.REFERENCES]] for p in prints]
    for _ in range(1500):
        n = int(rng.choice([4, 5, 9, 40, 101, 102, 103, 127, 128, 200, 409, 410, 500, 511, 512, 513, 1700, 2048]))
        pool = rng.integers(0, 1 << 64, 2 * n + 2, dtype=np.uint64)
        least = -(-4 * n // 5)
        both = int(rng.integers(least, n + 1))  # of the n shingles of a, and b has as many more as the limit allows
        extra = (5 * both - 4 * n) // 4
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n:n + extra])))
        assert similar.near(a, b)
        common = np.sort(rng.choice(pool, n // 2, replace=False))
        assert set(similar.filed_keys(a, common).tolist()) & set(similar.filed_keys(b, common).tolist())
        assert len(similar.filed_keys(a, common)) == (n // 4 + 1) * len(similar.part_counts(n))


def test_last_round_against_all_pairs(spark):
    """Without the first two rounds: all pairs of a bucket are compared, also of one that spans Arrow batches."""
    rng = random.Random(19)
    base = words(rng, 100, 5000)
    texts = [edited(rng, base, rng.randrange(1, 4)) for _ in range(250)]
    codes = similar.Codes()
    sets = {similar.node_of(x): x for x in (similar.shingles(t.encode(), codes) for t in texts)}
    rows = [(k, k, len(x), bytearray(similar.fingerprint(x))) for k, x in sets.items()]
    rows = spark.createDataFrame(rows + rows[:50], "node long, root long, n int, fp binary")
    counts = rows.distinct().select("node", "n", F.substring("fp", similar.WIDTH // 8 + 1, similar.COUNTS).alias("counts"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {tuple(r) for r in similar.crossing(rows, counts, lambda df: df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and similar.near(x, y)}
    assert want <= got and len(want) > 1000 and len(got) < len(sets) * (len(sets) - 1) / 2
