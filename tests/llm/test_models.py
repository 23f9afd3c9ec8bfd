"""Katz scores against a plain model, toxicity on held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fellscape.llm import katz, toxicity

from .conftest import words


class Plain:
    """The same model, n-gram by n-gram."""

    def __init__(self, texts):
        self.one = Counter(w for t in texts for w in t)
        self.two = Counter(p for t in texts for p in zip(["<s>", *t], t))
        self.history = Counter(h for t in texts for h in ["<s>", *t[:-1]])
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d1, self.d2 = (katz.discounts([Counter(c.values())[r] for r in range(1, 7)]) for c in (self.one, self.two))
        left = sum((1 - self.d1[c - 1]) * c for c in self.one.values() if c <= 5)
        self.total, self.unknown = (self.n, left / self.n) if left > 0 else (self.n + 1, 1 / (self.n + 1))
        if not left > 0:
            self.d1 = np.ones(5)
        follow = defaultdict(list)
        for (h, w), c in self.two.items():
            follow[h].append((w, c))
        self.back = {}
        for h, seen in follow.items():
            free = sum((1 - self.d2[c - 1]) * c for _, c in seen if c <= 5)
            below = self.history[h] if free > 0 else self.history[h] + 1
            self.back[h] = ((free or 1) / below / (1 - math.fsum(self.p(w) for w, _ in seen)), below)

    def p(self, w):
        c = self.one[w]
        return (self.d1[c - 1] if c <= 5 else 1) * c / self.total if c else self.unknown

    def after(self, h, w):
        if h not in self.back:
            return self.p(w)
        c = self.two[h, w]
        return (self.d2[c - 1] if c <= 5 else 1) * c / self.back[h][1] if c else self.back[h][0] * self.p(w)


def tokens(text):
    return [*(text or "").encode().lower().split(), "</s>"]


def is_training(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def compare(docs):
    rows = docs.select("doc_id", "text").collect()
    plain = Plain([tokens(r["text"]) for r in rows if is_training(r["doc_id"])])
    want = Counter()
    for r in rows:
        t = tokens(r["text"])
        base = sum(math.log10((plain.one[w] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in t)
        score = sum(math.log10(plain.after(h, w)) for h, w in zip(["<s>", *t], t))
        want[r["doc_id"], not is_training(r["doc_id"]), len(t), sum(plain.one[w] > 0 for w in t), plain.n, round(base, 6), round(score, 6)] += 1
    got = Counter((*r[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(docs).collect())
    assert got == want
    return plain


def test_scores_in_many_chunks_and_pieces(spark, sf, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 20_000)
    monkeypatch.setattr(katz, "SPLIT", 300)
    plain = compare(spark.read.parquet(f"{sf}/documents.parquet"))
    for h in ["<s>", *random.Random(1).sample(sorted(x for x in plain.back if x != "<s>"), 5)]:
        assert math.fsum(plain.after(h, w) for w in plain.one) + plain.after(h, b"\xff") == pytest.approx(1, abs=1e-9)


def test_scores_messy(spark, messy, nothing):
    compare(messy)
    assert katz.score(nothing).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(30) if not is_training(i)], "doc_id long, text string")
    rows = katz.score(held).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in rows)
    compare(spark.createDataFrame([(0, "a a a a a a a a"), (2, "a a a a a a a a"), (3, None)], "doc_id long, text string"))


def test_held_out_texts_score_above_the_base(spark, sf):
    rows = [r for r in katz.score(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_discounts():
    assert katz.discounts([100, 40, 20, 12, 8, 6]) == pytest.approx([(2 * 40 / 100 - .36) / .64, (3 * 20 / 80 - .36) / .64, (4 * 12 / 60 - .36) / .64, (5 * 8 / 48 - .36) / .64, (6 * 6 / 40 - .36) / .64])
    assert katz.discounts([10, 0, 0, 0, 0, 0]) == pytest.approx([.5, .75, 2.5 / 3, 3.5 / 4, .9])
    assert np.all(katz.discounts([0] * 6) > 0)


def test_pack():
    arrays = [np.arange(5, dtype=np.uint64), np.empty(0, np.uint32), np.array([1.5, -2.0]), np.array([3], np.uint8)]
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, katz.unpack(katz.pack(*arrays))))


def corpus(spark, n=1500):
    """Toxic texts hold words from a few stems, with varying ends; ordinary ones do not."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        text, toxic = words(rng, rng.randrange(40, 160), 900).split(), int(i % 5 == 0)
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["blorzak", "gruttnik", "vexxopla"]) + rng.choice(["", "ed", "ing", "s"])
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = toxicity.score(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1500 and {r["doc_id"] for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    assert right >= 0.97 * len(held)


def test_toxicity_messy(spark, messy, labels, nothing):
    rows = toxicity.score(messy, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in messy.collect())
    assert all(0 <= r["score"] <= 1 for r in rows) and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.score(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.score(messy, labels.limit(0)).collect()} == {0.0}


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(spark, 600)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_toxicity_window_by_window(spark):
    """Every window compressed on its own with either dictionary, and the curve by hand."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.sample(docs, labels))
    assert model.weights and model.toxic != model.ordinary and model.toxic.endswith(model.ordinary)
    plain, toxic = model.compressors()
    rows = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        cut = [b" " + b" ".join(w[i:i + toxicity.WINDOW]) + b" " for i in range(0, len(w), toxicity.WINDOW)]
        saved = [len(plain.compress(x)) - len(toxic.compress(x)) for x in cut]
        features = [min(max([0, *saved]), 12), math.log1p(sum(x for x in saved if x >= toxicity.EVIDENCE)), math.log1p(len(cut))]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], features))
        score = 1 / (1 + math.exp(-min(max(z, -30), 30)))
        got = rows[r["doc_id"]]
        assert got["score"] == pytest.approx(score, abs=1e-9) and got["predicted"] == int(score >= 0.7)
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_toxic_phrases_of_ordinary_words():
    """Words that occur everywhere score where their order is that of toxic texts."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(200)]
    phrases = [" ".join(rng.sample(vocabulary, 3)) for _ in range(6)]
    plain = lambda: [rng.choice(vocabulary) for _ in range(80)]

    def toxic():
        w = plain()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(phrases))
        return w

    make = lambda f, n: [" ".join(f()).encode() for _ in range(n)]
    model = toxicity.train([(t, 1) for t in make(toxic, 300)] + [(t, 0) for t in make(plain, 600)])
    high, low = (model.scores(model.features(make(f, 200), model.compressors())) for f in (toxic, plain))
    assert np.mean(high[:, None] > low[None, :]) > 0.95


def test_passages():
    telling = {b" scum", b"scum ", b"idiot"}
    assert toxicity.passages(b" you scum and idiots ", telling) == [b" scum ", b"idiot"]
    assert toxicity.passages(b" nothing here ", telling) == [] and toxicity.passages(b"", telling) == []
