"""Near copies by SimHash and tables of distances to reference fingerprints, verified by the similarity of five-word shingles.

*Fingerprints.*  A text is the set of its shingles of ``SHINGLE`` words, lower-cased as in ``simhash``; a shorter text
is one shingle.  Texts with equal sets are one node.  No SimHash of a whole text tells a similarity of 0.8 for certain, so the
shingles are also dealt over parts by their hash, and each part has a SimHash of 64 bits of its own.  Sets of
similarity 0.8 differ in at most a ninth of both sizes together, and each shingle that differs touches one part.  There are at least half
as many parts as shingles, so most parts of near copies have equal fingerprints.

*Table.*  Each part of a node gets the Hamming distances of its fingerprint to ``REFERENCES`` of the reference fingerprints of ``simhash``.
By the triangle inequality, parts that differ in a coordinate are not equal.  The coordinates of a part are its join key.

*Joins.*  Of the parts of a node, in one order for all nodes, the first ``n // 4 + 1`` are filed.  Near copies have at most ``n // 4``
parts that differ, so they share one that both have filed: no pair of similarity 0.8 is left out.  Parts with most shingles that are
not common come first, which keeps common passages out of the buckets.  What is common is estimated from up to ``SAMPLE``
documents; it sets the order only, and any order gives the same links.  The number of parts follows the size in steps; sizes whose
partners may lie beyond a step are filed for both numbers.

*Rounds.*  All rounds join on these keys and compare the proposed pairs exactly, shingle by shingle.  A first one over few keys, in which low nodes of
a bucket are its pivots, takes up large groups with few pairs a node and finds hubs, nodes with many links such as the
original of many copies that are less similar to each other.  A second one over more keys begins with the hubs of each
bucket, goes on in random order, and proposes pairs of different components only.  In both a pair of more than ``LIMIT`` differing bits
of ``WIDTH`` is passed over and a node within it of ``COVER`` pivots is not one itself, so a group of any size costs its nodes, not its pairs.
The last round is over all keys and pivots nothing: every pair of different components that shares a key is proposed, unless the distance of
the two in ``COUNTS`` counts of shingles, which is at most the number of shingles that differ, proves them apart.

So all links are exact and none between different components is missed, but for collisions of 64-bit hashes.
NULL and empty texts have the empty set and are copies of each other.
Texts are taken whole, however long.  Two texts under one id are two documents; of rows that repeat id and text one stays.  Rows without an
id come after all others.  An empty table gives an empty result.  Working columns take names that ``docs`` does not use.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from fellscape.llm.common import binary_rows, broadcast_if_small, fresh, in_batches
from fellscape.llm.components import components
from fellscape.llm.simhash import references
from fellscape.session import scratch

SHINGLE = 5
NEAR, OF = 4, 5  # similarity of near copies: 4/5
WIDTH = 256
#: Differing bits that sets of the least similarity exceed hardly ever.
APART = math.acos(2 * NEAR / (NEAR + OF)) / math.pi
LIMIT = math.floor(WIDTH * APART + 4 * math.sqrt(WIDTH * APART * (1 - APART)))
#: References of the table; a distance takes seven bits, a row of nine one long.
REFERENCES = 9
PIVOTS = references(REFERENCES)
COUNTS = 256
LEAST_PARTS = 64
FIRST_KEYS, SECOND_KEYS, COVER = 6, 12, 2
EARLIER = 8
#: Bytes of a fingerprint that the first two rounds read.
BRIEF = WIDTH // 8 + COUNTS + 8 * SECOND_KEYS
SAMPLE, COMMON, MOST_COMMON = 4_000, 5, 100_000
CHUNK = 1024
BATCH_BYTES = 4 << 20
MEMO_WORDS = 200_000


class Codes(dict):
    """Hash of a word; forgets everything when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, codes: Codes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ code[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def node_of(items: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(items.tobytes()) - (1 << 63)


def part_counts(n: int) -> list[int]:
    """Numbers of parts under which a set of ``n`` shingles is filed: its own, and the next if a larger near copy may have that."""
    own = LEAST_PARTS
    while n >= 2 * own:
        own *= 4
    return [own, 4 * own] if n * OF // NEAR >= 2 * own else [own]


def simhashes(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of 64 bits of each stretch of ``items``; the stretches begin at ``starts``."""
    ends, out = np.append(starts[1:], len(items)), np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), 4096):
        own, sizes = starts[k:k + 4096], (ends - starts)[k:k + 4096]
        bits = np.unpackbits(items[own[0]:ends[k + len(own) - 1]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, own - own[0], axis=0, dtype=np.int64)
        out[k:k + 4096] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def distances(prints: np.ndarray) -> np.ndarray:
    """The table: a row of distances to the references for each fingerprint."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS)


def filed_keys(items: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys of the first parts of a set: number of parts, part and coordinates of its fingerprint."""
    if not len(items):
        return np.empty(0, np.uint64)
    where, at = mixed(items ^ np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(common, items)
    plain = np.append(common, np.uint64(0))[at] != items if len(common) else np.ones(len(items), bool)
    shifts, keys = np.uint64(7) * np.arange(REFERENCES, dtype=np.uint64), []
    for parts in part_counts(len(items)):
        part = where & np.uint64(parts - 1)
        order = np.argsort(part, kind="stable")
        dealt = part[order]
        starts = np.append(0, np.flatnonzero(dealt[1:] != dealt[:-1]) + 1)
        present = dealt[starts]
        prints, rare = simhashes(mixed(items[order] + np.uint64(0x94D049BB133111EB)), starts), np.add.reduceat(plain[order].astype(np.int64), starts)
        wanted = len(items) // 4 + 1
        if len(present) < wanted:  # parts without shingles are equal in both sets, or count as one that differs
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), present)
            present, prints, rare = np.append(present, empty), np.append(prints, np.zeros_like(empty)), np.append(rare, np.full(len(empty), -1))
        row = (distances(prints).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
        key = mixed(row ^ mixed(present + np.uint64(parts << 32)))
        keys.append(key[np.lexsort((key, -rare))[:wanted]])
    return np.concatenate(keys)


def fingerprint(items: np.ndarray, common: np.ndarray = np.empty(0, np.uint64)) -> bytes:
    """``WIDTH`` bits, each set if it is in over half of the hashes derived from the shingles; ``COUNTS`` counts; the keys of the filed parts.

    A count is the number of shingles (255 at most) whose hash has that remainder.
    """
    lanes = mixed(items[:, None] + np.arange(1, WIDTH // 64 + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    ones = np.zeros(WIDTH, np.int64)
    for k in range(0, len(lanes), 4096):
        ones += np.add.reduce(np.unpackbits(lanes[k:k + 4096].astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    counts = np.minimum(np.bincount((mixed(items) % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS), 255).astype(np.uint8)
    return np.packbits(2 * ones > len(items), bitorder="little").tobytes() + counts.tobytes() + filed_keys(items, common).astype("<u8").tobytes()


def _opened(fps: pa.Array, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all fingerprints, ``most`` of each, and the row each belongs to."""
    keys = [np.frombuffer(fp, "<i8", offset=WIDTH // 8 + COUNTS)[:most] for fp in fps.to_pylist()]
    return np.concatenate(keys or [np.empty(0, np.int64)]), np.repeat(np.arange(len(keys)), [len(k) for k in keys])


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have at least the similarity of near copies."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (NEAR + OF) * both >= NEAR * (len(a) + len(b))


def _mapped(rows: DataFrame, schema: str, kinds: list, value) -> DataFrame:
    """``rows`` (first column kept, ``raw`` last) with what ``value`` makes of the shingles of each text."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kept = [c for c in rows.columns if c != "raw"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            columns = list(zip(*(value(shingles(t.as_py(), codes)) for t in batch.column("raw")))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=kept + names)

    return in_batches(rows).mapInArrow(run, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), schema]))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``doc_id, tx, raw``: id, hash and bytes of each text."""
    column = F.col(f"`{text}`")
    return docs.select("doc_id", F.xxhash64(column).alias("tx"), column.cast("binary").alias("raw"))


def common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles in at least ``COMMON`` of up to about ``SAMPLE`` different texts, chosen by hash; the most frequent, if many.

    They set the order of the parts and with it the size of the buckets; the links do not depend on them.
    """
    share = max(1, docs.count() // SAMPLE)
    some = _keyed(docs, text).where(F.pmod("tx", F.lit(share)) == 0).dropDuplicates(["tx"]).select("tx", "raw")
    items = _mapped(some, "items array<long>", [pa.list_(pa.int64())], lambda x: (x.view(np.int64),)).select(F.explode("items").alias("item"))
    often = items.groupBy("item").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "item").limit(MOST_COMMON)
    return np.sort(often.select("item").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def proposed(nodes: DataFrame, again: bool) -> DataFrame:
    """``a, b``: nodes and the pivots of their buckets within the limit; of other components only if ``again``.

    ``nodes`` has ``node, n, fp`` and, for the second round, ``root`` and ``links``, the number of verified links.
    """
    schema = "key long, rank int, node long, root long, n int, fp binary"

    def filed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                keys, at = _opened(part.column("fp"), SECOND_KEYS if again else FIRST_KEYS)
                bits = pa.array([fp[:WIDTH // 8] for fp in part.column("fp").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(part.column(c).take(pa.array(at)) for c in ("rank", "node", "root", "n")), bits.take(pa.array(at))],
                                                 names=["key", "rank", "node", "root", "n", "fp"])

    class Bucket:
        """Pivots of one bucket and what they propose."""

        def __init__(self, key: int) -> None:
            self.key, self.node, self.root, self.n = key, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            self.fp = np.empty((0, WIDTH // 64), np.uint64)

        def _within(self, fp: np.ndarray, n: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            apart = np.bitwise_count(fp[:, None] ^ others[None]).sum(axis=2, dtype=np.int16)
            return (apart <= LIMIT) & (np.minimum(n[:, None], sizes) * OF >= np.maximum(n[:, None], sizes) * NEAR)

        def take(self, rank: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
            order = np.lexsort((mixed(node.view(np.uint64) ^ np.uint64(self.key & (1 << 64) - 1)), rank)) if again else np.argsort(node, kind="stable")
            for k in range(0, len(order), CHUNK):
                yield from self._chunk(*(x[order[k:k + CHUNK]] for x in (node, root, n, fp)))

        def _chunk(self, node, root, n, fp) -> Iterator[tuple[int, int]]:
            known = len(self.node)
            old, own = self._within(fp, n, self.fp, self.n), np.tril(self._within(fp, n, fp, n), -1)
            fresh = []
            for i in range(len(node)):
                hits = [(int(self.node[r]), int(self.root[r])) for r in np.flatnonzero(old[i])] if known and old[i].any() else []
                if own[i].any():
                    hits += [(int(node[r]), int(root[r])) for r in fresh if own[i, r]]
                for other, label in hits[:COVER] if again else hits[:1]:
                    if label != root[i] or not again:
                        yield other, int(node[i])
                if len(hits) < (COVER if again else 1):
                    fresh.append(i)
            self.node, self.root, self.n, self.fp = (np.concatenate((old, new[fresh])) for old, new in ((self.node, node), (self.root, root), (self.n, n), (self.fp, fp)))

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for batch in batches:
            key, rank, node, root = (batch.column(c).to_numpy() for c in ("key", "rank", "node", "root"))
            n = batch.column("n").to_numpy().astype(np.int64)
            fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), "<u8").reshape(-1, WIDTH // 64)
            ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
            pairs, start = [], 0
            for end in ends:
                if bucket is None or bucket.key != key[start]:
                    bucket = Bucket(int(key[start]))
                if end - start > 1 or len(bucket.node) or end == ends[-1]:
                    pairs += bucket.take(rank[start:end], node[start:end], root[start:end], n[start:end], fp[start:end])
                start = end
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in (0, 1)], names=["a", "b"])

    rows = nodes if again else nodes.withColumn("root", F.col("node")).withColumn("links", F.lit(0))
    rows = rows.select((-F.col("links")).cast("int").alias("rank"), "node", "root", "n", "fp").mapInArrow(filed, schema)
    rows = rows.repartition("key").sortWithinPartitions("key", "rank", "node")
    pairs = rows.mapInArrow(compared, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crossed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Pairs within whole buckets, sorted by key and size, of different roots that their sizes and counts do not prove apart.

    A pair that shares one of the ``EARLIER`` keys before this one is left to that bucket, so the lowest shared key always proposes it.
    """
    key, node, root, n = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("key", "node", "root", "n"))
    counts = np.frombuffer(b"".join(c for b in batches for c in b.column("counts").to_pylist()), np.uint8).reshape(-1, COUNTS)
    before = [b.column("before") for b in batches]
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in before])
    earlier, held = np.zeros((len(key), EARLIER), np.int64), np.arange(EARLIER) < sizes[:, None]
    earlier[held] = np.concatenate([x.flatten().to_numpy() for x in before])
    n, rows, found = n.astype(np.int64), np.arange(len(key)), []
    for shift in range(1, len(key)):  # each shift takes one row further
        rows = rows[rows + shift < len(key)]
        rows = rows[(key[rows] == key[rows + shift]) & (NEAR * n[rows + shift] <= OF * n[rows])]
        if not len(rows):
            break
        left = rows[root[rows] != root[rows + shift]]
        for k in range(0, len(left), 4096):
            i = left[k:k + 4096]
            apart = np.abs(counts[i].astype(np.int16) - counts[i + shift]).sum(axis=1, dtype=np.int64)
            i = i[(NEAR + OF) * apart <= (OF - NEAR) * (n[i] + n[i + shift])]
            again = (earlier[i][:, :, None] == earlier[i + shift][:, None]) & held[i][:, :, None] & held[i + shift][:, None]
            i = i[~again.any(axis=(1, 2))]
            found.append(np.stack((node[i], node[i + shift])))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], names=["a", "b"])


def crossing(rows: DataFrame, counts: DataFrame, cut) -> DataFrame:
    """``a, b``: every pair of nodes of different roots that share a key, unless proven apart.

    ``rows`` has ``node, root, fp``, a node any number of times, and ``counts`` has ``node, n, counts``, each once.
    """

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                keys, at = _opened(part.column("fp"))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(part.column(c).take(pa.array(at)) for c in ("node", "root"))], names=["key", "node", "root"])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            ends = np.flatnonzero(np.diff(key)) + 1
            if len(ends):  # the last bucket may go on in the next batch
                yield _crossed([*held, batch.slice(0, ends[-1])])
                held = [batch.slice(ends[-1])]
            elif held and key[0] != last:
                yield _crossed(held)
                held = [batch]
            else:
                held.append(batch)
            last = key[-1]
        if held:
            yield _crossed(held)

    own = Window.partitionBy("key")
    keys = rows.select("node", "root", "fp").mapInArrow(opened, "key long, node long, root long")
    keys = keys.withColumn("met", F.min("root").over(own) != F.max("root").over(own)).where("met")
    met = cut(keys.select("key", "node", "root").distinct()).join(counts, "node")
    earlier = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1)).alias("before")
    met = met.select("key", "node", "root", "n", "counts", earlier)
    pairs = met.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(compared, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, cut) -> DataFrame:
    """The pairs ``a, b`` of nodes that are near copies, compared on their whole sets."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = cut(asked.join(nodes, "node").select("node", F.col("first.doc_id").alias("asked_id"), F.col("first.tx").alias("asked_tx")))
    rows = _keyed(docs, text).join(broadcast_if_small(asked), F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("tx") == F.col("asked_tx")))
    items = _mapped(rows.select("node", "raw"), "items array<long>", [pa.list_(pa.int64())], lambda x: (x.view(np.int64),))
    items = cut(items.groupBy("node").agg(F.first("items").alias("items")))
    work = (pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("ours")), "a")
            .join(items.select(F.col("node").alias("b"), F.col("items").alias("theirs")), "b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [near(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)) for x, y in zip(batch.column("ours"), batch.column("theirs"))]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return in_batches(work.select("a", "b", "ours", "theirs")).mapInArrow(run, "a long, b long")


def _labelled(docs: DataFrame, text: str, cut) -> tuple[DataFrame, DataFrame]:
    """``doc_id, tx, node`` of each row, and ``node, root`` of all nodes with the first row of the root's component."""
    kinds, common = [pa.int64(), pa.int32(), pa.binary()], common_shingles(docs, text)
    rows = cut(_mapped(_keyed(docs, text), "node long, n int, fp binary", kinds, lambda x: (node_of(x), len(x), fingerprint(x, common))))
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tx")
    brief = F.substring("fp", 1, BRIEF).alias("fp")
    nodes = cut(rows.select("node", "doc_id", "tx", "n", brief).groupBy("node").agg(F.min(key).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp")))

    def rooted(links: DataFrame) -> DataFrame:
        return nodes.join(components(links, "a", "b", cut), "node", "left").withColumn("root", F.coalesce("root", "node"))

    pairs = cut(proposed(nodes, False))
    links = cut(verified(pairs, nodes, docs, text, cut))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    hubs = cut(rooted(links).join(degree, "node", "left").withColumn("links", F.coalesce("links", F.lit(0))).select("node", "root", "links", "n", "fp"))
    more = cut(proposed(hubs, True).join(pairs, ["a", "b"], "left_anti"))
    links = cut(links.unionAll(verified(more, nodes, docs, text, cut)))
    pairs = pairs.unionAll(more)
    names = rooted(links).select("node", "root", F.col("first.doc_id").alias("first_id"), F.col("first.tx").alias("first_tx"))
    once = rows.join(names, "node").where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tx") == F.col("first_tx")))
    counts = nodes.select("node", "n", F.substring("fp", WIDTH // 8 + 1, COUNTS).alias("counts"))
    more = cut(crossing(once, counts, cut).join(pairs, ["a", "b"], "left_anti"))
    links = cut(links.unionAll(verified(more, nodes, docs, text, cut)))
    placed = cut(rooted(links).select("node", "first", "root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    return rows.select("doc_id", "tx", "node"), placed.join(heads, "root").select("node", "head")


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, tx, component_id``, a row per row: the smallest id that links reach, NULL where no row has one.

    ``tx`` is the hash of the text.
    """
    with scratch(docs.sparkSession) as cut:
        rows, heads = _labelled(docs, text, cut)
        return cut.kept(rows.join(heads, "node").select("doc_id", "tx", F.col("head.doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """One whole row of each group of near copies: of the rows with the smallest ``doc_id``, that with the smallest hash of its text.

    Rows without an id come after all others.  Of rows that repeat both id and text, the first by the
    text form of their other columns stays.
    """
    tx, row, gone_id, gone_tx, again_id, again_tx = fresh(docs, "tx", "row", "gone_id", "gone_tx", "again_id", "again_tx")
    with scratch(docs.sparkSession) as cut:
        rows, heads = _labelled(docs, text, cut)
        key = [F.col("doc_id").eqNullSafe(F.col("head.doc_id")), F.col("tx") == F.col("head.tx")]
        named = cut(rows.join(heads, "node").withColumn("stays", key[0] & key[1]))
        gone = cut.kept(named.where("not stays").select(F.col("doc_id").alias(gone_id), F.col("tx").alias(gone_tx)).distinct())
        again = named.where("stays").groupBy("doc_id", "tx").count().where("count > 1")
        again = cut.kept(again.select(F.col("doc_id").alias(again_id), F.col("tx").alias(again_tx)))
    whole = docs.withColumn(tx, F.xxhash64(F.col(f"`{text}`")))

    def same(ids: str, hashes: str) -> Column:
        return F.col("doc_id").eqNullSafe(F.col(ids)) & (F.col(tx) == F.col(hashes))

    kept = whole.join(broadcast_if_small(gone), same(gone_id, gone_tx), "left_anti")
    repeated = broadcast_if_small(again)
    once = kept.join(repeated, same(again_id, again_tx), "left_anti")
    form = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", text)])) if len(docs.columns) > 2 else F.lit("")
    twice = kept.join(repeated, same(again_id, again_tx), "left_semi")
    first = twice.groupBy("doc_id", tx).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), form).alias(row)).select(f"{row}.*")
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(first)
