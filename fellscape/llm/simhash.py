"""Near duplicates by 64-bit SimHash, linked through tables of distances to reference fingerprints.

*Table.* Each distinct fingerprint gets its Hamming distances to many reference fingerprints.  By
the triangle inequality two fingerprints within ``limit`` bits differ by at most ``limit`` in
every coordinate.  Two families of references are used:

* For each of six segments of the 64 bits, a common base reference with one bit of the segment
  flipped at a time.  The distance to such a reference minus the distance to the base says how
  the fingerprint stands at that bit, and depends on that segment alone.  Two changed bits touch
  at most two segments, so fingerprints within the limit agree in these coordinate differences
  on at least four whole segments.  They meet in one of the 15 hash joins on four segments,
  which is exact and needs no pair of unrelated fingerprints.
* Random references, whose coordinates discard the pairs that meet by chance.

*Verification.* Pairs that survive are compared bit by bit.

A join bucket leaves 20 to 22 bits open, so it holds at most 2**22 distinct fingerprints, however
many documents share them.  A bucket of more than ``SMALL_BUCKET`` is split again: of three parts
of its open bits at least one is equal within the limit, so the parts are joined the same way,
down to buckets that are small by their number of open bits.  Buckets return a spanning forest of
their links, not all pairs; connected components of these edges are those of all links.

NULL and empty texts have the fingerprint zero and are linked like others.  Texts are taken whole, however long.  Equal fingerprints are one node, so
repeated rows cost nothing more and get a row each; ids of NULL link others and stay NULL.  An empty table gives an empty result.  Only ``doc_id`` and the
text column are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fellscape.llm.common import binary_rows
from fellscape.llm.components import components
from fellscape.session import cut

SHINGLE, SEED, LIMIT = 3, 42, 2
SEGMENTS = (11, 11, 11, 11, 10, 10)
SMALL_BUCKET = 64
RANDOM_REFERENCES = 24
BATCH_BYTES = 8 << 20


def fingerprint(text: bytes | None) -> int:
    """SimHash of the word shingles of a whole text, each as often as it occurs; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", len(words) - size + 1)
    ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones.astype(np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long, a row per row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            values = np.array([fingerprint(t.as_py()) for t in batch.column("raw")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "fp"])

    source = docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias("raw"))
    return source.mapInArrow(run, "doc_id long, fp long")


def references(count: int = RANDOM_REFERENCES) -> np.ndarray:
    """Random reference fingerprints, the same on every run."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, count, dtype=np.uint64)


def segment_masks() -> list[int]:
    at = [0, *itertools.accumulate(SEGMENTS)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:])]


def joins(limit: int = LIMIT) -> list[int]:
    """Bits that agree in each join: all but ``limit`` of the segments."""
    masks = segment_masks()
    return [sum(kept) for kept in itertools.combinations(masks, len(masks) - limit)]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _parts(mask: int, count: int) -> list[int]:
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(bits[i::count]) for i in range(count)]


def _pairs(key: np.ndarray, fp: np.ndarray, distances: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of rows with one key, rows sorted by key; each shift takes one row further."""
    rows = np.arange(len(key))
    for shift in range(1, len(key)):
        rows = rows[rows + shift < len(key)]
        rows = rows[key[rows] == key[rows + shift]]
        if not len(rows):
            return
        i = rows
        for c in range(distances.shape[0]):
            i = i[np.abs(distances[c, i] - distances[c, i + shift]) <= limit]
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= limit]
        yield i, i + shift


def forest(key: np.ndarray, fp: np.ndarray, opened: int, limit: int = LIMIT) -> np.ndarray:
    """For rows of distinct fingerprints sorted by key: a row of the same linked set under each row."""
    pivots = references()
    label = np.arange(len(key))

    def root(rows: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := label[rows], rows):
            rows = up
        return rows

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = root(a), root(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            differ = low != high
            a, b = low[differ], high[differ]
            np.minimum.at(label, b, a)

    def link(rows: np.ndarray, keys: np.ndarray, opened: int) -> None:
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(first, len(keys)))
        small = np.repeat((sizes <= SMALL_BUCKET) & (sizes > 1), sizes)
        if small.any():
            own, k = rows[small], keys[small]
            table = np.bitwise_count(fp[own][None, :] ^ pivots[:, None]).astype(np.int8)
            for a, b in _pairs(k, fp[own], table, limit):
                unite(own[a], own[b])
        for start, size in zip(first[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
            own = rows[start:start + size]
            for part in _parts(opened, limit + 1):
                value = fp[own] & np.uint64(part)
                order = np.argsort(value, kind="stable")
                link(own[order], value[order], opened & ~part)

    if len(key):
        link(np.arange(len(key)), key, opened)
    return root(np.arange(len(key)))


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``a, b``: edges between distinct fingerprints (column ``fp``) whose components are those of all links."""
    kept = joins(limit)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                               for i, m in enumerate(kept)]))
    rows = (prints.select("fp").distinct().select("fp", keys.alias("k")).select("k.at", "k.key", "fp")
            .repartition("at", "key").sortWithinPartitions("at", "key", "fp"))

    def bucket(at: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        for i in np.unique(at):
            own = at == i
            value, f = key[own].view(np.uint64), fp[own].view(np.uint64)
            label = forest(value, f, (1 << 64) - 1 & ~kept[i], limit)
            moved = label != np.arange(len(label))
            a.append(f[moved].view(np.int64))
            b.append(f[label[moved]].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)]
            at, key, _ = held
            last = int(np.flatnonzero((at[1:] != at[:-1]) | (key[1:] != key[:-1]))[-1]) + 1 if np.any(
                (at[1:] != at[:-1]) | (key[1:] != key[:-1])) else 0
            if last:  # the last bucket may go on in the next batch
                yield bucket(*[h[:last] for h in held])
                held = [h[last:] for h in held]
        if len(held[0]):
            yield bucket(*held)

    return rows.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id``, a row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach.  NULL and empty texts have the
    fingerprint zero and are linked like others.  A NULL ``doc_id`` stays NULL; its fingerprint still
    links others, and a component without any id has a NULL ``component_id``.
    """
    prints = cut(fingerprints(docs.select("doc_id", text), text))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    roots = components(links(nodes, limit), "a", "b")
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = cut(placed)
    named = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    names = cut(placed.join(named, "root").select("fp", "component_id"))
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
