"""Periodic runs against a search of every period, and the digests of the registered query."""

import hashlib
import random
import zlib

import __spark_entry__ as entry
from fellscape.llm import periodic


def brute(w, shortest=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= 2 * q:
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= shortest)


def left_over(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def drawn(rng):
    """Small alphabets, nested repetitions and repetitions whose unit is itself periodic."""
    k = rng.choice([1, 2, 2, 3, 5, 30])
    some = lambda m: [b"%d" % rng.randrange(k) for _ in range(m)]
    w = some(rng.randrange(0, 30))
    for _ in range(rng.randrange(0, 6)):
        kind = rng.random()
        if kind < 0.7:
            u = some(rng.randrange(1, 40)) if kind < 0.3 else (some(rng.randrange(1, 5)) * 30)[:rng.randrange(1, 90)] + some(rng.randrange(0, 2))
            w += u * rng.randrange(1, 6) + u[:rng.randrange(len(u))]
        else:
            w += some(rng.randrange(0, 60))
    return w


def test_against_every_period():
    rng = random.Random(21)
    for shortest in (2, 12):
        for _ in range(8):
            texts = [drawn(rng) for _ in range(40)]
            for w, rows in zip(texts, periodic.all_runs(texts, shortest)):
                assert [tuple(r) for r in rows.tolist()] == brute(w, shortest)


def test_hard_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 700:
        a, b = b, b + a
    morse = [b"%d" % (bin(i).count("1") % 2) for i in range(600)]
    units = [b"a"] + [b"b", b"a", b"a"] * 40
    for w in (a, b, morse, units * 2, [b"x"] + units * 2 + [b"b"], [b"x"] * 500, [], [b"x"]):
        assert [tuple(r) for r in periodic.all_runs([w], 2)[0].tolist()] == brute(w, 2)


def test_colliding_fingerprints_are_noticed(monkeypatch):
    codes = periodic.np.arange(40) % 8
    runs = periodic.np.array([[0, 40, 8]])
    assert periodic.proven(codes, runs) and not periodic.proven(codes, periodic.np.array([[0, 40, 7]])) and not periodic.proven(codes, periodic.np.array([[1, 40, 8]]))
    real, calls = periodic.candidates, []

    def wrong(codes, longest, seed):
        calls.append(seed)
        return real(codes, longest, seed) + (periodic.np.array([0, 0, 1]) if len(calls) == 1 else 0)

    monkeypatch.setattr(periodic, "candidates", wrong)
    assert [tuple(r) for r in periodic.all_runs([[b"%d" % (i % 8) for i in range(40)]])[0].tolist()] == [(0, 40, 8)] and calls == [0, 1]


def expected(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (doc_id, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left_over(w, runs)).hexdigest())


def test_query(spark, sf):
    rows = [tuple(r) for r in entry.queries()["op12_periodic_runs"](spark, sf).collect()]
    assert sorted(rows) == sorted(expected(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sum(r[2] > 0 for r in rows) >= 10


def test_messy(spark, messy, nothing, tmp_path):
    for name, docs in (("messy", messy), ("nothing", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = entry.queries()["op12_periodic_runs"](spark, f"{tmp_path}/{name}").collect()
        want = [expected(r["doc_id"], r["text"]) for r in docs.where("doc_id != 63 or doc_id is null").collect()]
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted((tuple(r) for r in rows if r["doc_id"] != 63), key=key) == sorted(want, key=key)
    real = periodic.mark(messy.where("doc_id = 61 or text is null"))
    assert {(len(r["runs"]), r["collapsed"]) for r in real.collect()} == {(0, "")}
