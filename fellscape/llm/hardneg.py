"""Hard negatives by inner product, read from Hilbert-ordered blocks through zone maps.

*Blocks.*  Components become ``floor(scale * x)``.  Rows are sorted along a Hilbert curve through the grid of
``2**BITS`` cells a dimension (ties by label, id and vector, so that equal vectors split like others) and written
as Parquet rows of ``BLOCK`` vectors each, with the least and greatest value of every dimension and of the
label: the zone map.  Every writing task has a folder (``shelf``), and a scan opens the folders of wanted blocks only.

*Bounds.*  Interval arithmetic on a zone map bounds the product of an anchor with every vector of
the block from both sides.  Anchors are packed by their order on the curve, and packs are
compared with packs of zone maps; no row meets another row there.

*Windows.*  An anchor first reads its own block.  What it finds there is the bound that other blocks have to
beat for its positives.  With the positives known, each has a window of scores in percent of its own score;
again the own block gives a first bound, and blocks are read whose interval meets what is left of
a window.  Blocks that tie with a bound are read, since ids decide ties.  All results are exact.

Rows with a NULL id, label or vector, or with a NULL or non-finite component take no part.  Shorter
vectors count as filled up with zeros.  Rows are rows: one that repeats another, or only its id,
is ranked beside it.  An anchor without positives, or a positive without negatives in its window, has no row
in the result.  An empty table, or one of empty vectors, gives an empty result or scores of zero.  Other columns are
not read.  Products beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fellscape.session import cut, run_path, task_count

BLOCK, PACK, ZONES = 512, 256, 256
BITS = 4
SCALE = 256
LOW_PERCENT, HIGH_PERCENT = 80, 100
LEAST = -(1 << 62)
BROADCAST_BYTES = 32 << 20
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def hilbert(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place on the Hilbert curve of each row of cell numbers, as bytes that sort like it."""
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    for k in range(bits - 1, 0, -1):
        below = np.uint32((1 << k) - 1)
        for i, axis in enumerate(x):
            high = (axis >> np.uint32(k) & np.uint32(1)).astype(bool)
            swapped = np.where(high, np.uint32(0), (x[0] ^ axis) & below)
            x[0] ^= np.where(high, below, swapped)
            if i:
                x[i] ^= swapped
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.uint32)
    for k in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint32(k) & np.uint32(1), np.uint32((1 << k) - 1), np.uint32(0))
    x ^= turn
    planes = (x[None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & np.uint32(1)
    packed = np.packbits(planes.reshape(bits * len(x), -1).astype(np.uint8), axis=0)
    return [row.tobytes() for row in packed.T]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _vectors(column: pa.Array, d: int, scale: float) -> np.ndarray:
    """Scaled components of list rows, filled up with zeros to ``d``."""
    out = np.zeros((len(column), d))
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    values = np.floor(scale * column.values.to_numpy(zero_copy_only=False).astype(float))
    out[np.arange(d) < sizes[:, None]] = values[ends[0]:ends[-1]]
    return out


def _ranges(rows: DataFrame, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scaled component of each dimension; one small row per task and dimension."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.empty(0), np.empty(0)
        for batch in batches:
            column = batch.column("v")
            d = max(len(low), int(np.diff(column.offsets.to_numpy()).max(initial=0)))
            x = _vectors(column, d, scale)
            fill = np.zeros(d - len(low))
            low, high = (f(np.concatenate((old, fill)), f.reduce(x, axis=0, initial=0)) for f, old in ((np.minimum, low), (np.maximum, high)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["k", "low", "high"])

    found = rows.select("v").mapInArrow(run, "k long, low double, high double").groupBy("k").agg(F.min("low"), F.max("high")).orderBy("k").collect()
    return np.array([r[1] for r in found]), np.array([r[2] for r in found])


def blocks(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """The written block table of ``id, label, v, anchor``."""
    low, high = _ranges(rows, scale)
    d = len(low)
    if d * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) ** 2 * HIGH_PERCENT >= 2.0 ** 62:
        raise OverflowError("scaled vectors are too long for products of 64 bits")
    width = np.maximum((high - low + 1) / 2 ** BITS, 1e-300)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("v"), d, scale)
            cells = np.minimum((x - low) / width, 2 ** BITS - 1) if d else x
            keys = hilbert(cells, BITS) if d and len(x) else [b""] * len(x)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("label"), batch.column("id"), batch.column("anchor"),
                                              pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=["key", "label", "id", "anchor", "v"])

    table = cut(rows.select("id", "label", "v", "anchor").mapInArrow(keyed, "key binary, label long, id long, anchor boolean, v binary"))
    schema = "shelf int, block long, d int, ids binary, labels binary, anchors binary, v binary, low binary, high binary, low_label long, high_label long"

    def blocked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows: list) -> pa.RecordBatch:
            nonlocal number
            labels, ids, anchors, v = zip(*rows)
            x = np.frombuffer(b"".join(v), "<i8").reshape(len(rows), d)
            number += 1
            return _batch(schema, [[c] for c in (
                shelf, (shelf << 32) + number, d, np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), np.array(anchors, bool).tobytes(),
                x.tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), min(labels), max(labels))])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("label", "id", "anchor", "v")))
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield block(held)

    order = ["key", "label", "id", "v"]
    made = table.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocked, schema)
    path = run_path(rows.sparkSession, "blocks")
    made.write.partitionBy("shelf").parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def _array(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<i8")


def packs(table: DataFrame) -> DataFrame:
    """Anchors in packs, in the order of their blocks: ``pack, d, ids, labels, homes, places, v``."""
    schema = "pack long, d int, ids array<long>, labels binary, homes binary, places binary, v binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, d = TaskContext.get().partitionId(), 0, [], 0

        def pack(rows: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            columns = list(zip(*rows))
            return _batch(schema, [[c] for c in ((task << 32) + number, d, columns[0], *(np.array(c, "<i8").tobytes() for c in columns[1:4]), b"".join(columns[4]))])

        for batch in batches:
            for row in batch.to_pylist():
                d = row["d"]
                at = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                ids, labels, v = _array(row["ids"]), _array(row["labels"]), row["v"]
                held += [(ids[k], labels[k], row["block"], k, v[8 * d * k:8 * d * (k + 1)]) for k in at]
                while len(held) >= PACK:
                    yield pack(held[:PACK])
                    held = held[PACK:]
        if held:
            yield pack(held)

    return table.select("block", "d", "ids", "labels", "anchors", "v").mapInArrow(run, schema)


def own_blocks(anchors: DataFrame) -> DataFrame:
    """``pack, block, which``: the anchors of a pack that lie in a block, as places in the pack."""
    schema = "pack long, block long, which binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                homes = _array(row["homes"])
                rows += [(row["pack"], int(b), np.flatnonzero(homes == b).astype("<i8").tobytes()) for b in np.unique(homes)]
            yield _batch(schema, list(zip(*rows)) or [[]] * 3)

    return anchors.select("pack", "homes").mapInArrow(run, schema)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer rows: in doubles where these hold every partial sum."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2.0 ** 52 else a @ b.T


def _states(column: pa.ListArray) -> list[np.ndarray]:
    """Columns ``at, slot, score, id, least`` of what the pack of each row is looking for."""
    cells = np.column_stack([column.values.field(c).to_numpy().astype(np.int64) for c in ("at", "slot", "score", "id", "least")])
    return np.split(cells, column.offsets.to_numpy()[1:-1]) if len(column) else []


def zone_packs(table: DataFrame) -> DataFrame:
    """Zone maps of ``ZONES`` blocks to a row."""
    schema = "zone_pack long, block binary, low binary, high binary, low_label binary, high_label binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, []

        def packed(rows: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ints = [np.array([r[c] for r in rows], "<i8").tobytes() for c in ("block", "low_label", "high_label")]
            return _batch(schema, [[c] for c in ((task << 32) + number, ints[0], b"".join(r["low"] for r in rows), b"".join(r["high"] for r in rows), *ints[1:])])

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= ZONES:
                yield packed(held[:ZONES])
                held = held[ZONES:]
        if held:
            yield packed(held)

    return table.select("block", "low", "high", "low_label", "high_label").mapInArrow(run, schema)


def wanted_blocks(zones: DataFrame, anchors: DataFrame, negative: bool) -> DataFrame:
    """``pack, block, which``: blocks, but an anchor's own, whose bounds meet what the anchor still looks for."""
    tiles = max(1, min(zones.count(), 2 * task_count(zones.sparkSession)))
    tile = F.pmod(F.xxhash64("zone_pack"), F.lit(tiles)).cast("int").alias("tile")
    # each pack of anchors goes to every tile of zone maps: packs against packs, in blocks
    dealt = anchors.select("pack", "d", "labels", "homes", "v", "state", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    schema = "pack long, block long, which binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, state in zip(batch.drop_columns(["state"]).to_pylist(), _states(batch.column("state"))):
                block, labels, homes = _array(row["block"]), _array(row["labels"]), _array(row["homes"])
                at, score, least = state[:, 0], state[:, 2:3], state[:, 4:]
                a = _array(row["v"]).reshape(len(labels), row["d"])[at]
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                low, high = (_array(row[c]).reshape(len(block), row["d"]) for c in ("low", "high"))
                low_label, high_label, label = _array(row["low_label"]), _array(row["high_label"]), labels[at][:, None]
                most = _product(up, high) + _product(down, low)
                want = (most >= least) & (block != homes[at][:, None])
                if negative:
                    want &= (100 * most >= LOW_PERCENT * score) & (100 * (_product(up, low) + _product(down, high)) <= HIGH_PERCENT * score)
                    want &= (low_label != label) | (high_label != label)
                else:
                    want &= (low_label <= label) & (label <= high_label)
                out += [(row["pack"], int(block[z]), np.unique(at[want[:, z]]).astype("<i8").tobytes()) for z in np.flatnonzero(want.any(axis=0))]
            yield _batch(schema, list(zip(*out)) or [[]] * 3)

    return dealt.join(zones.withColumn("tile", tile), "tile").mapInArrow(run, schema)


def _first(owner: np.ndarray, column: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each owner by descending score and ascending id."""
    order = np.lexsort((ids[column], -score, owner))
    owner = owner[order]
    start = np.searchsorted(owner, owner)
    return order[np.arange(len(owner)) - start < k]


def _broadcast_packs(anchors: DataFrame) -> DataFrame:
    """Broadcast written packs whose bytes are few, counted; others are left to a shuffled join."""
    size = anchors.agg(F.sum(F.octet_length("v") + F.octet_length("labels") * 3 + F.size("state") * 40)).first()[0] or 0
    return F.broadcast(anchors) if size <= BROADCAST_BYTES else anchors


def scanned(table: DataFrame, wanted: DataFrame, anchors: DataFrame, k: int, negative: bool) -> DataFrame:
    """``pack, at, slot, score, id``: the first ``k`` of each wanted block for each anchor, or for each of its windows."""
    wanted = cut(wanted)
    shelves = [r[0] for r in wanted.select(F.shiftright("block", 32).cast("int")).distinct().collect()]  # one per writing task at most
    opened = table.where(F.col("shelf").isin(shelves)).select("block", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("v").alias("b_v"))
    work = wanted.join(opened, "block").join(_broadcast_packs(anchors.drop("ids")), "pack")
    schema = "pack long, at int, slot int, score long, id long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, state in zip(batch.drop_columns(["state"]).to_pylist(), _states(batch.column("state"))):
                d, which = row["d"], _array(row["which"])
                ids, labels, own_labels = _array(row["b_ids"]), _array(row["b_labels"]), _array(row["labels"])
                b = _array(row["b_v"]).reshape(len(ids), d)
                a = _array(row["v"]).reshape(len(own_labels), d)[which]
                score = _product(a, b)
                same = own_labels[which][:, None] == labels
                home = np.flatnonzero(_array(row["homes"])[which] == row["block"])
                state = state[np.isin(state[:, 0], which)]
                line = np.searchsorted(which, state[:, 0])  # the row of ``score`` of each search
                found = score[line]
                ok = found >= state[:, 4:]
                if negative:
                    ok &= ~same[line] & (100 * found <= HIGH_PERCENT * state[:, 2:3]) & (100 * found >= LOW_PERCENT * state[:, 2:3])
                else:
                    same[home, _array(row["places"])[which][home]] = False
                    ok &= same[line]
                r, c = np.nonzero(ok)
                best = _first(r, c, found[r, c], ids, k)
                r, c = r[best], c[best]
                yield _batch(schema, [np.full(len(r), row["pack"]), state[r, 0].astype(np.int32), state[r, 1].astype(np.int32), found[r, c], ids[c]])

    return work.mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each search, with ``rank`` from 1."""
    order = W.partitionBy("pack", "at", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searching(anchors: DataFrame, searches: DataFrame) -> DataFrame:
    """Packs with their searches (``at, slot, score, id, least``; a bounded number a pack)."""
    state = searches.groupBy("pack").agg(F.collect_list(F.struct("at", "slot", "score", "id", "least")).alias("state"))
    return cut(anchors.drop("state").join(state, "pack"))


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
         label: str = "label", scale: float = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors.  Positives are the first other rows of the same label by score; negatives the
    first rows of other labels with a score between ``LOW_PERCENT`` and ``HIGH_PERCENT`` of the positive's.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & v.isNotNull() & finite)
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v"),
                       F.coalesce(anchor, F.lit(False)).alias("anchor"))
    table = blocks(rows, scale)
    anchors = cut(packs(table))
    zones, own = cut(zone_packs(table)), cut(own_blocks(anchors))
    names = cut(anchors.select("pack", F.posexplode("ids").alias("at", "anchor_id")))

    def both(searches: DataFrame, k: int, negative: bool) -> DataFrame:
        """Own blocks first, then the blocks that can beat what they gave."""
        searches = cut(searches.withColumn("least", F.lit(LEAST)))
        first = cut(_ranked(scanned(table, own, _searching(anchors, searches), k, negative), k))
        bounds = first.where(F.col("rank") == k).select("pack", "at", "slot", F.col("score").alias("bound"))
        then = searches.join(bounds, ["pack", "at", "slot"], "left").withColumn("least", F.coalesce("bound", "least")).drop("bound")
        then = _searching(anchors, then)
        more = scanned(table, wanted_blocks(zones, then, negative), then, k, negative)
        return _ranked(first.drop("rank").unionByName(more), k)

    zero = F.lit(0).cast("long")
    near = both(names.select("pack", "at", F.lit(0).alias("slot"), zero.alias("score"), zero.alias("id")), positives, False)
    windows = cut(near.select("pack", "at", (F.col("rank") - 1).alias("slot"), "score", "id"))
    hard = both(windows, negatives, True).select("pack", "at", "slot", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    windows = windows.select("pack", "at", "slot", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    return hard.join(windows, ["pack", "at", "slot"]).join(names, ["pack", "at"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The registered query in SQL, where ids are unique.
SQL = """
WITH base AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM base a JOIN base b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n
                   FROM scored WHERE label = anchor_label) WHERE n <= 5),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS n
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.label
    WHERE 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE n <= 5
"""
