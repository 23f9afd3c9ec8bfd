"""SimHash groups, components and aligned line deduplication against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fellscape.llm import components, linededup, simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(prints, limit=2):
    prints = np.array(prints, np.uint64)
    label = np.arange(len(prints))
    near = [np.flatnonzero(np.bitwise_count(p ^ prints) <= limit) for p in prints]
    changed = True
    while changed:
        changed = False
        for i, n in enumerate(near):
            if (low := label[n].min()) < label[i]:
                label[i], changed = low, True
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b", "É È é a b c a b c", "x " * 50, "a b c\x1cd e\x0bf"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_print(text)


def test_query_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in entry.queries()["op3_simhash_near_dedup"](spark, sf).collect()}
    ids = sorted(docs)
    prints = [brute_print(docs[i]) for i in ids]
    assert [int(rows[i]["fingerprint"], 16) for i in ids] == prints and all(len(rows[i]["fingerprint"]) == 16 for i in ids)
    assert [rows[i]["component_id"] for i in ids] == [ids[k] for k in brute_groups(prints)]


def test_dense_clusters():
    """Thousands of fingerprints around few centres, so that buckets are split again."""
    rng = np.random.default_rng(3)
    prints = set(map(int, rng.integers(0, 1 << 63, 200)))
    for centre in list(prints)[:20]:
        for _ in range(40):
            x = centre
            for _ in range(rng.integers(1, 5)):
                x ^= 1 << int(rng.integers(64))
            prints.add(x)
    centre = next(iter(prints))
    for _ in range(900):
        x = centre
        for _ in range(rng.integers(1, 7)):
            x ^= 1 << int(rng.integers(20))
        prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for mask in simhash.joins():
        key = prints & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        label = simhash.forest(key[order], prints[order], (1 << 64) - 1 & ~mask)
        for i in np.flatnonzero(label != np.arange(len(label))):
            a, b = find(order[i]), find(order[label[i]])
            parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == brute_groups(prints).tolist()


def test_messy(spark, messy, nothing):
    source = messy.collect()
    rows = simhash.near_copies(messy).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in rows) == sorted((str(r["doc_id"]), format(brute_print(r["text"]), "016x")) for r in source)
    group = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    assert group[64, format(brute_print(source[3]["text"]), "016x")] == 3 and group[61, "0" * 16] == 60 and group[None, "0" * 16] == 60
    assert simhash.near_copies(nothing).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, k) for k in range(1001, 1400)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges += [(5, 5), (None, 3), (7, None), (8, 9), (9, 8)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def lcs_ok(a, b, pairs):
    return all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_patience():
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(15))]
        b = [rng.randrange(12) for _ in range(rng.randrange(15))]
        assert lcs_ok(a, b, linededup.patience(a, b))
    base = list(range(40))
    assert len(linededup.patience(base, [99, *base[:20], 98, 97, *base[20:]])) == 40
    assert linededup.patience([], [1]) == [] and linededup.patience([1, 1], [1, 1]) == [(0, 0), (1, 1)]


def test_repeated_passages(spark, sf):
    """Every line of enough words that an earlier document holds goes, and no line goes that none holds."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in entry.queries()["op5_aligned_line_dedup"](spark, sf).collect()}
    first = {}
    for i in sorted(docs):
        lines = [x.strip(" \t\n\r\v\f") for x in docs[i].split("\n")]
        gone = set(rows[i]["removed"])
        for k, line in enumerate(lines):
            if k in gone:
                assert first[line] < i
            else:
                assert line not in first or len(line.split()) < 20 or lines.count(line) > 1
        assert rows[i]["text"] == "\n".join(x for k, x in enumerate(docs[i].split("\n")) if k not in gone)
        for line in lines:
            first.setdefault(line, i)
    assert set(rows) == set(docs) and sum(len(r["removed"]) > 0 for r in rows.values()) > 10


def test_line_dedup_messy(spark, messy, nothing):
    passage = "\n".join(" ".join(f"p{k}q{j}" for j in range(12)) for k in range(6))
    extra = [(100, f"start of one\n{passage}\nend"), (101, f"another\n\n{passage}\nmore"), (102, passage), (102, passage), (103, "p0q0 p0q1\nshort line"), (104, "x\nshort line")]
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("removed", F.lit("?"))
    rows = linededup.without_repeats(docs).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == docs.count() and not got[100][0]["removed"]
    assert got[101][0]["text"] == "another\n\nmore" and got[101][0]["removed_words"] == 72
    assert [r["text"] for r in got[102]] == ["", ""] and not got[104][0]["removed"]
    assert got[60][0]["text"] is None and got[61][0]["text"] == "" and all(not r["removed"] for r in got[None])
    assert got[64][0]["text"] == ""  # a copy of document 3
    assert linededup.without_repeats(nothing).count() == 0
