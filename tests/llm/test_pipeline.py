"""The pipeline against brute force, stage by stage, and its columns on messy input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__ as entry
from fellscape.llm import decontaminate, quality

from .test_native import whole_shards
from .test_quality import brute as counts_of
from .test_similar import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = {}
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        fn(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        stage[name] = docs.collect()
        assert docs.columns == COLUMNS + (["shard", "slot"] if k == 4 else [])
    whole = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    # quality: what the base rules reject goes; the cutoffs have too few labels at this size to reject more
    good = {i for i, r in whole.items() if not (lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0])(counts_of(r["text"]))}
    assert {r["doc_id"] for r in stage["quality_rules"]} == good
    # near duplicates: the smallest id of each group
    alone = {k for i, k in brute_components({i: whole[i]["text"] for i in good}).items() if i == k}
    assert {r["doc_id"] for r in stage["near_duplicates"]} == alone
    # decontamination: documents holding all eight-word runs of an item go, those sharing none stay
    plain = lambda t: [w for w in (x.strip(".,!?") for x in t.lower().split()) if any(c.isalnum() for c in w)]
    runs = [{tuple(w[k:k + 8]) for k in range(len(w) - 7)} for w in (plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())]
    clean = {r["doc_id"] for r in stage["decontamination"]}
    for i in alone:
        words = plain(whole[i]["text"])
        own = {tuple(words[k:k + 8]) for k in range(len(words) - 7)}
        if any(r and r <= own for r in runs):
            assert i not in clean
        if not any(r & own for r in runs):
            assert i in clean
    # mixture: words of each source near its target, no document more than twice
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", whole[i]["text"])) for i in clean}
    copies = Counter(r["doc_id"] for r in stage["mixture"])
    assert set(copies) <= clean and max(copies.values()) <= 2
    have, taken = defaultdict(int), defaultdict(int)
    for i in clean:
        have[whole[i]["source"]] += size[i]
        taken[whole[i]["source"]] += copies[i] * size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(have))}
    left, rest, target = 1.5 * sum(have.values()), set(have), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        full = {s for s in rest if share[s] >= 2 * have[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * have[s]
            left -= target[s]
        rest -= full
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in have)
    # shards: the same rows, whole shards
    assert Counter(r["doc_id"] for r in stage["shards"]) == copies and whole_shards(stage["shards"], sum(copies.values()))
    rows = [tuple(r) for r in stage["shards"]]
    assert sorted(rows) == sorted(tuple(r) for r in entry.queries()["pipeline"](spark, sf).collect())


def test_messy(spark, messy, labels, nothing, tmp_path):
    """Every stage takes NULLs, repeated rows, clashing columns and empty tables."""
    sf = str(tmp_path / "tables")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "x")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, docs in (("messy", messy), ("nothing", nothing)):
        first = docs.columns
        for k, (stage, fn) in enumerate(corpus_pipeline.STAGES):
            fn(spark, docs, sf).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert docs.columns == [c for c in first if c != "shard"] + ["shard", "slot"]
    assert docs.count() == 0


def test_units():
    assert quality.Risk().max_false_rejection < 0.05 and decontaminate.WINDOW == 8 and corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixture", "shards"]
