"""Licence scans against a search of every place, and planted notices with edits."""

import math
import random
import re
from collections import Counter

import __spark_entry__ as entry
from fellscape.llm import licenses
from fellscape.llm.license_texts import TEMPLATES

from .conftest import words


def read(text):
    return [w for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def places(w, phrase):
    p = read(phrase)
    return [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]


def brute(texts, templates=TEMPLATES):
    """``n_words, base, matches`` of each text by trying every beginning of every template."""
    own = [read(t) for t in texts]
    seen = Counter(x for w in own for x in set(w))
    out = []
    for w in own:
        where = {}
        for i, x in enumerate(w):
            where.setdefault(x, []).append(i)
        base = sorted((i, label) for p, label in licenses.BASE for i in places(w, p))
        matches = []
        for t, (label, text, needs) in enumerate(templates):
            body = read(text)
            weight = lambda j: math.log((len(own) + 1) / (seen[body[j]] + 1)) + 1e-6
            posted = sorted(range(len(body)), key=lambda j: (-weight(j), j))[:max(4, -(-len(body) // 3))]
            begin = {}
            for j in posted:
                for i in where.get(body[j], []):
                    begin.setdefault(i - j, set()).add(j)
            total, good = sum(weight(j) for j in posted), []
            for o in sorted(begin):
                agree = {j for x in range(o, o + licenses.SLACK + 1) for j in begin.get(x, ())}
                share = sum(weight(j) for j in agree) / total
                place = w[max(o - licenses.SLACK, 0):max(0, o + len(body) + 2 * licenses.SLACK)]
                if share >= licenses.SHARE - 1e-9 and all(places(place, p) for p in needs):
                    good.append((o, min(share, 1.0)))
            while good:
                near = [g for g in good if g[0] < good[0][0] + len(body)]
                o, share = max(near, key=lambda g: (round(g[1], 9), -g[0]))
                matches.append((max(o, 0), t, label, round(share, 6)))
                good = good[len(near):]
        out.append((len(w), base, sorted(matches)))
    return out


def scanned(df):
    return {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["base"]], [(m["start"], m["template"], m["label"], round(m["score"], 6)) for m in r["matches"]])
            for r in licenses.scan(df).collect()}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k:k + 1] = rng.choice(([f"z{rng.randrange(99)}"], [], [w[k], "Added"]))
    return " ".join(w)


def test_against_every_place(spark):
    rng = random.Random(31)
    texts = [words(rng, 80) for _ in range(20)] + ["", None, "MIT", "mit-license", "The MIT Licenses", "MIT\nLicense mit license mit license"]
    for label, text, _ in TEMPLATES:
        for edits in (0, 3, 10):
            texts.append(f"{words(rng, rng.randrange(0, 40))} {edited(rng, text, edits)} {words(rng, 20)}")
        texts += [text[:len(text) // 2], " ".join(rng.sample(text.split(), len(text.split()))), f"{text} {words(rng, 9)} {text}"]
    texts.append(" ".join(rng.choice(("software", "license", "the", "mit", "general", "public")) for _ in range(3000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert scanned(docs) == dict(enumerate(brute(texts)))


def test_notices_are_found_with_edits_and_not_without_their_phrases(spark):
    rng = random.Random(32)
    rows, want = [], {}
    for k, (label, text, needs) in enumerate(TEMPLATES):
        if len(text.split()) > 40:
            for e in range(4):
                rows.append((len(rows), f"{words(rng, 60)} {edited(rng, text, 2)} {words(rng, 60)}"))
                want[len(rows) - 1] = label
            rows.append((len(rows), " ".join(w for w in text.split() if w.lower().strip(',.;"') not in set(needs[-1].split()))))
            want[len(rows) - 1] = None
    got = {i: {m[2] for m in r[2]} for i, r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).items()}
    hits = [want[i] in got[i] for i in got if want[i]]
    assert sum(hits) >= 0.85 * len(hits)  # an edit may fall into a mandatory phrase
    assert all(not got[i] for i in got if want[i] is None)


def digest(doc_id, found):
    n, base, matches = found
    at = [i for i, _ in base]
    both = {x for _, x in base} | {m[2] for m in matches}
    score = max([0.5] * bool(base) + [m[3] for m in matches], default=0.0)
    return doc_id, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(both)), round(score, 6)


def rows_of(df):
    return sorted(((*r[:-1], round(r[-1], 6)) for r in df.collect()), key=str)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [digest(r["doc_id"], f) for r, f in zip(docs, brute([r["text"] for r in docs]))]
    df = entry.queries()["op11_rare_word_licenses"](spark, sf)
    assert rows_of(df) == sorted(want, key=str) and any(w[2] for w in want)
    assert dict(df.dtypes)["n_base"] == "bigint" and dict(df.dtypes)["score"] == "double"


def test_messy(spark, messy, nothing, tmp_path):
    for name, docs in (("messy", messy.where("doc_id is null or doc_id != 63")), ("nothing", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = docs.collect()
        want = [digest(r["doc_id"], f) for r, f in zip(rows, brute([r["text"] for r in rows]))]
        assert rows_of(entry.queries()["op11_rare_word_licenses"](spark, f"{tmp_path}/{name}")) == sorted(want, key=str)
    assert licenses.scan(messy.where("doc_id = 63")).first()["n_words"] == 30_000
