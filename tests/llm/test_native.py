"""SQL forms; URL reputation, mixing and sharding by brute force and exact sizes."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from fellscape.llm import mixing, reputation, sharding


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_url_reputation", "op4_systematic_mixing"])
def test_same_as_sql(spark, sf, name):
    state, _, _, note = check.compare(spark, check.connect(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok", note


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_on_the_native_paths(spark, sf):
    for name in ("op2_url_reputation", "op4_systematic_mixing", "op10_hypergeometric_shards"):
        assert not any(word in plan_of(entry.queries()[name](spark, sf)) for word in ("Python", "Pandas", "Arrow"))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net/x", "http://net", "http://net/", "http://xnet/", "https://example.net/en/1?q#f",
            "https://a.EXAMPLE.net/en/", "https://example.net/en", "ftp://b.example.com/de/x", "x://fr.org/fr/a://b", "http://é.org?x/fr/",
            "http://ÀB.org#/fr/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.net/x", None)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in reputation.judge(pages, labels).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("a.net", "/x", "net/", "block") and got[5] == ("net", "", None, "allow") and got[6] == ("net", "/", "net/", "block")
    assert got[7][2] is None and got[8] == ("example.net", "/en/1", "example.net/en/", "allow") and got[9][2] == "example.net/en/"
    assert got[10][2:] == ("net/", "block") and got[11] == ("b.example.com", "/de/x", "example.com/de/", "block")
    assert got[12] == ("fr.org", "/fr/a://b", "org/fr/", "allow") and got[13] == ("é.org", "", None, "allow") and got[14][0] == "Àb.org"
    assert reputation.judge(pages.limit(0), labels).count() == 0 and reputation.judge(pages, labels.limit(0)).count() == len(urls) + 1


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows = [("bad.x.com", i, i % 10 < 9) for i in range(200)] + [("good.x.com", 200 + i, i % 10 < 1) for i in range(400)]
    rows += [(f"h{k}.x.com", 600 + k, k % 20 == 0) for k in range(300)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for h, i, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if bad else 1, 0) for _, i, bad in rows], "doc_id long, quality int, toxic int")
    got = {r["host"]: r["verdict"] for r in reputation.judge(pages, labels).select("host", "verdict").distinct().collect()}
    assert [h for h, verdict in got.items() if verdict == "block"] == ["bad.x.com"]  # one bad page does not condemn a host


@pytest.mark.parametrize("host, domain, suffix", [
    ("a.com", "a.com", "com"), ("x.y.a.com", "a.com", "com"), ("com", "com", "com"), ("", "", ""), ("a.co.uk", "a.co.uk", "co.uk"), ("x.a.co.uk:8080", "a.co.uk", "co.uk"),
    ("co.uk", "co.uk", "co.uk"), ("me.github.io", "me.github.io", "github.io"), ("b.s3.amazonaws.com.", "b.s3.amazonaws.com", "s3.amazonaws.com"), ("u:p@w.a.com:", "a.com", "com"),
    ("10.0.0.1:99", "10.0.0.1", "(address)"), ("[::1]:80", "[::1]", "(address)"), ("1.2.3.com", "3.com", "com"), ("é.uk", "é.uk", "uk")])
def test_registered_domains(spark, host, domain, suffix):
    row = spark.createDataFrame([(host,)], "h string").select(reputation.domain_of(F.col("h")), reputation.suffix_of(F.col("h"))).first()
    assert tuple(row) == (domain, suffix)


def test_domains_below_long_suffixes_are_pooled(spark, tmp_path):
    """Pages lie one to a host; only the registered domain tells bad hosts from good ones, also for a host without labels."""
    rows = [(i, f"http://h{i}.{'bad' if i % 2 else 'good'}.co.uk:80/p") for i in range(400)] + [(900, "http://new.bad.co.uk/"), (901, "http://new.good.co.uk/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    verdict = {r["page_id"]: r["verdict"] for r in reputation.judge(pages, labels).collect()}
    assert all(verdict[i] == ("block" if i % 2 else "allow") for i in range(400)) and verdict[900] == "block" and verdict[901] == "allow"
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    state, _, _, note = check.compare(spark, check.connect(str(tmp_path)), str(tmp_path), "op2", entry.queries()["op2_url_reputation"], reputation.SQL)
    assert state == "ok", note


def test_posterior(spark):
    """The summed posterior against the exact binomial form of the Beta distribution."""
    from math import comb
    rows = [(a, b) for a in (1, 3, 40, 300) for b in (1, 7, 60, 280)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double")
    got = [r[0] for r in df.select(reputation.exceeds("a", "b", 0.5)).collect()]
    want = [sum(comb(a + b - 1, j) for j in range(a)) / 2 ** (a + b - 1) for a, b in rows]
    assert got == pytest.approx(want, abs=0.01)


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 2000, "e": 0, None: 300}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [3, 1, 2, 3, 1, 2]))
    open_, left, want = set(sizes), 1.5 * sum(sizes.values()), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            want.update(share)
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= full
    assert got == pytest.approx(want)


def test_mixing_messy(spark, messy, nothing):
    rows = mixing.taken(messy).collect()
    assert len(rows) == messy.count() and all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"] for r in rows)
    out = mixing.mixed(messy)
    assert out.columns == messy.columns
    words = out.withColumn("w", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    assert (words.agg(F.sum("w")).first()[0] or 0) == sum(r["taken"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(messy.repartition(7)).collect()))
    assert mixing.taken(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_taken_is_near_the_target(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
                                      F.repeat(F.lit("w "), (F.pmod(F.hash("id"), F.lit(60)) + 1).cast("int")).alias("text"))
    got = mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert len(got) == 6 and all(abs(r["t"] - r["target"]) < 0.01 * r["target"] + 60 for r in got)


def test_draw_is_hypergeometric(spark):
    """Frequencies of draws against the exact probabilities, and bounds of the support."""
    from math import comb
    k, r, m = 9, 20, 7
    u = spark.range(20_000).select((F.col("id") / 20_000 + 0.000025).alias("u"))
    got = Counter(x[0] for x in u.select(F.expr(sharding.draw(f"{k}L", f"{r}L", f"{m}L", "u"))).collect())
    for x in range(max(0, m - (r - k)), min(k, m) + 1):
        assert got[x] / 20_000 == pytest.approx(comb(k, x) * comb(r - k, m - x) / comb(r, m), abs=2e-4)
    edge = spark.sql(f"SELECT {sharding.draw('0L', '5L', '3L', '0.5D')} a, {sharding.draw('5L', '5L', '3L', '0.5D')} b, {sharding.draw('0L', '0L', '0L', '0.5D')} c").first()
    assert tuple(edge) == (0, 3, 0)


def test_matrix_keeps_both_margins(spark):
    counts = {p: (p * 37) % 90 for p in range(64) if p % 5}
    df = spark.createDataFrame(list(counts.items()), "p long, c long")
    total = sum(counts.values())
    rows = {r["node"]: r["margin"] for r in sharding.matrix(df, total, 6, sharding.Layout()).collect()}
    assert {p: sum(m) for p, m in rows.items()} == {p: counts.get(p, 0) for p in range(64)}
    columns = [sum(m[s] for m in rows.values()) for s in range(40)]
    assert sum(columns) == total and max(columns) - min(columns) <= 1 and all(x >= 0 for m in rows.values() for x in m)


def whole_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(40)]
    return sum(sizes) == n and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_messy(spark, messy, nothing):
    rows = sharding.shards(messy).collect()
    source = messy.collect()
    assert whole_shards(rows, len(source)) and all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    digest = lambda r: (r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(map(digest, source))
    out = sharding.shuffled(messy)
    assert out.columns == [c for c in messy.columns if c != "shard"] + ["shard", "slot"]
    got = out.collect()
    assert whole_shards(got, len(source)) and Counter(map(digest, got)) == Counter(map(digest, source))
    assert Counter((*digest(r), r["shard"], r["slot"]) for r in got) == Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert sharding.shards(nothing).count() == 0 and sharding.shuffled(nothing).count() == 0


def test_shuffle_is_uniform_and_repeats(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shards(docs).collect()}
    assert rows == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shards(docs.repartition(5)).collect()}
    cells = Counter((i * 8 // 8000, s // 5, t // 25) for i, (s, t) in rows.items())  # 8 x 8 x 8 cells of 15.6 rows
    chi = sum((cells[a, b, c] - 15.625) ** 2 / 15.625 for a in range(8) for b in range(8) for c in range(8))
    assert 380 < chi < 650  # about 500 degrees of freedom


def test_copies_part_ways(spark):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shards(docs).collect()
    assert whole_shards(rows, 4000)
