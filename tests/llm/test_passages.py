"""Line deduplication: every passage of enough words that an earlier document holds goes, against brute force."""

import random

from fellscape.llm import linededup


def brute(docs, min_words=20):
    """Lines inside a run of lines of enough words that some earlier document holds; all lines have words."""
    out = {}
    for i in sorted(docs):
        gone = set()
        for e in (k for k in docs if k < i):
            for a in range(len(docs[i])):
                for s in range(len(docs[e])):
                    n = 0
                    while a + n < len(docs[i]) and s + n < len(docs[e]) and docs[i][a + n] == docs[e][s + n]:
                        n += 1
                    if sum(len(x.split()) for x in docs[i][a:a + n]) >= min_words:
                        gone.update(range(a, a + n))
        out[i] = sorted(gone)
    return out


def removed(spark, docs):
    rows = linededup.without_repeats(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string"))
    return {r["doc_id"]: r["removed"] for r in rows.collect()}


def line(name, n=12):
    return " ".join(f"{name}_{k}" for k in range(n))


def test_windows_of_later_holders(spark):
    """B and C share a passage whose lines were each seen earlier in different documents."""
    p = [line(f"p{k}") for k in range(4)]
    docs = {k: [line(f"a{k}"), p[k], line(f"z{k}")] for k in range(4)}
    docs |= {10: [line("b"), *p], 11: [*p, line("c")]}
    assert removed(spark, docs) == {0: [], 1: [], 2: [], 3: [], 10: [], 11: [0, 1, 2, 3]}


def test_hot_passage_beside_a_rare_line(spark):
    """A passage of more than 1000 documents inside a copied document."""
    p = [line("p0"), line("p1")]
    docs = {k: [f"own {k} a", *p, f"own {k} b"] for k in range(1010)}
    docs |= {2000: ["x start", *p, "x end"], 2001: ["x start", *p, "x end"]}
    got = removed(spark, docs)
    assert got[0] == [] and got[2000] == [1, 2] and got[2001] == [0, 1, 2, 3]
    assert all(got[k] == [1, 2] for k in range(1, 1010))


def test_against_brute_force(spark):
    """Lines from a small set: passages repeat in either document, move and overlap."""
    rng = random.Random(21)
    pool = [line(f"w{k}", rng.choice([1, 3, 8, 15, 25])) for k in range(14)]
    docs = {i: [rng.choice(pool) if rng.random() < 0.9 else line(f"o{i}x{k}", 5) for k in range(rng.randrange(1, 25))] for i in range(40)}
    assert removed(spark, docs) == brute(docs)


def test_repeated_in_either():
    h, d = [1, 7, 8, 2, 7, 8, 3], [4, 7, 8, 5]
    for earlier, later, want in ((h, d, [1, 2]), (d, h, [1, 2, 4, 5])):
        held = linededup.windows(earlier, [12] * len(earlier), 20).values()
        assert linededup.common_blocks(earlier, later, [12] * len(later), 20, held) == want
