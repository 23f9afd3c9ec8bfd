"""Hard negatives against all pairs, the curve, and what zone maps leave unread."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fellscape.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=5):
    rows = [(i, [math.floor(256 * float(x)) for x in v], k) for i, v, k in rows
            if None not in (i, v, k) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, k) in enumerate(rows):
        if i % 100:
            continue
        score = [sum(a * b for a, b in zip(v, w)) for _, w, _ in rows]
        order = sorted(range(len(rows)), key=lambda m: (-score[m], rows[m][0]))
        for p in [m for m in order if rows[m][2] == k and m != n][:positives]:
            hard = [m for m in order if rows[m][2] != k and 80 * score[p] <= 100 * score[m] <= 100 * score[p]]
            out += [(i, rows[p][0], r + 1, rows[m][0], score[p], score[m]) for r, m in enumerate(hard[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("d, bits", [(1, 4), (2, 3), (3, 3), (4, 2)])
def test_curve_takes_single_steps(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2 ** bits)] * d, indexing="ij"), -1).reshape(-1, d)
    keys = hardneg.hilbert(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert set(np.abs(np.diff(walk, axis=0)).sum(axis=1)) == {1}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    monkeypatch.setattr(hardneg, "PACK", 4)
    monkeypatch.setattr(hardneg, "ZONES", 5)
    monkeypatch.setattr(hardneg, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-8, 9, 3) / 16).tolist(), int(rng.integers(0, 4))) for i in range(700)]  # many ties
    rows += [(700, [0.5, 0.25, 0.0], 1)] * 3 + [(7000 + i, [0.5, 0.25, 0.0], i % 2) for i in range(60)]  # repeats and a hot vector
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute(rows) and len(got) > 150


def test_messy(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.4], 1), (2, [0.8, 0.5], 2), (3, [0.8], 2), (4, [], 2), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 2),
            (8, [inf, 1.0], 1), (9, [0.9, 0.4], None), (None, [0.9, 0.4], 1), (100, [0.0, 0.0], 1), (100, [0.0, 0.0], 2), (200, [-1.0, 0.2], 3), (300, [-0.5, 0.1, 0.9], 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "pack", "block", "anchor", "state", "shelf")})
    mined = hardneg.mine(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in mined.collect()) == brute(rows)
    assert mined.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hardneg.mine(df.limit(0), F.lit(True)).count() == 0
    assert hardneg.mine(df.select("vec_id", "label", F.array().cast("array<float>").alias("embedding")), F.col("vec_id") == 0).count() == 5 * 5
    with pytest.raises(OverflowError):
        hardneg.mine(spark.createDataFrame([(0, [1e30], 1)], SCHEMA), F.lit(True))


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """In clustered data an anchor opens few blocks beside its own."""
    monkeypatch.setattr(hardneg, "BLOCK", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.02).tolist(), int(rng.integers(0, 3))) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    opened, real = [], hardneg.wanted_blocks

    def counted(zones, anchors, negative):
        found = real(zones, anchors, negative)
        opened.append(found.agg(F.sum(F.octet_length("which") / 8)).first()[0] or 0)
        return found

    monkeypatch.setattr(hardneg, "wanted_blocks", counted)
    assert sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 100 == 0).collect()) == brute(rows)
    assert all(0 < n < 0.2 * 40 * (4000 / 32) for n in opened)


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rows = sorted(tuple(r) for r in entry.queries()["op13_zone_map_negatives"](spark, sf).collect())
    assert rows == sorted(con.execute(entry.oracle_sql()["op13_zone_map_negatives"]).fetchall()) and len(rows) > 50
