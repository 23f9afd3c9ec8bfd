"""Line deduplication by pairwise alignment of documents that share passages.

1. *Overlaps.*  A window is a shortest run of lines of at least ``min_words`` words from a line onwards or back
   from a line.  Windows cover every line of every passage long enough to delete.  Each window that an
   earlier document holds pairs the document with the window's first holder, the document with the smallest id.
   A window in any number of documents gives each of them one partner, so pairs grow with the lines,
   never with the square of a group.
2. *Alignment.*  The line hashes of a pair are aligned as in a patience diff: equal ends, then lines that
   occur once in both as anchors along their longest increasing chain, then the gaps again.
3. *Deletion.*  Aligned blocks, adjacent in both documents, of at least ``min_words`` words leave the later
   document, and then every window that the earlier one holds anywhere: passages that occur several
   times in either, or in another order, have no place in one alignment.  Lines without words neither break a block
   nor are deleted.

Lines are compared without outer white space.  A document is a pair of id and text; rows that repeat both
are treated alike, and rows without an id are left as they are.

NULL stays NULL, and empty texts have one empty line.  Texts are taken whole, however long.  Of lines that occur equally often the earlier
counts as the rarer.  An empty table gives an empty result.  Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fellscape.llm.common import binary_rows
from fellscape.session import cut

BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Blocks:
    min_words: int = 20


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal values, increasing in both sequences."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = (Counter(x) for x in (a[a0:a1], b[b0:b1]))
        place = {v: i for i, v in enumerate(b[b0:b1], b0) if once_b[v] == 1 and once_a.get(v) == 1}
        anchors = [(i, place[v]) for i, v in enumerate(a[a0:a1], a0) if v in place]
        ends, tails, before = [], [], [-1] * len(anchors)  # longest increasing chain
        for n, (_, j) in enumerate(anchors):
            k = bisect_left(ends, j)
            before[n] = tails[k - 1] if k else -1
            ends[k:k + 1], tails[k:k + 1] = [j], [n]
        chain, n = [], tails[-1] if tails else -1
        while n >= 0:
            chain.append(anchors[n])
            n = before[n]
        if chain:
            at, bt = a0, b0
            for i, j in reversed(chain):
                todo.append((at, i, bt, j))
                out.append((i, j))
                at, bt = i + 1, j + 1
            todo.append((at, a1, bt, b1))
    return sorted(out)


def windows(hashes: Sequence[int], words: Sequence[int], min_words: int) -> dict[tuple[int, int], int]:
    """Hash of each shortest run of lines of enough words that starts or ends at a line, by start and stop."""
    total, n = [0, *accumulate(words)], len(words)
    spans = set()
    for i in range(n):
        stop = bisect_left(total, total[i] + min_words)
        if stop <= n:
            spans.add((i, stop))
        start = bisect_right(total, total[i + 1] - min_words) - 1
        if start >= 0:
            spans.add((start, i + 1))
    raw = array("q", hashes).tobytes()
    return {(a, b): xxhash.xxh64_intdigest(raw[8 * a:8 * b]) - (1 << 63) for a, b in spans}


def common_blocks(earlier: Sequence[int], later: Sequence[int], words: Sequence[int], min_words: int, held: Iterable[int] = ()) -> list[int]:
    """Positions of the later document in aligned blocks of enough words, and in windows that the earlier one has (``held``)."""
    out, block = set(), []
    for i, j in [*patience(earlier, later), (-1, -1)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[y] for _, y in block) >= min_words:
                out.update(y for _, y in block)
            block = []
        block.append((i, j))
    if len(out) < len(later):
        held = set(held)
        for (a, b), h in windows(later, words, min_words).items():
            if h in held:
                out.update(range(a, b))
    return sorted(out)


def lines(docs: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """``doc_id, text_hash, hashes, words, places`` of the lines with words, and hashes of ``windows``; a row per document."""
    schema = "doc_id long, text_hash long, hashes array<long>, words array<int>, places array<int>, windows array<long>"
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            hashes, words, places = [], [], []
            for text in batch.column("raw"):
                found = [(x.strip(), i) for i, x in enumerate((text.as_py() or b"").split(b"\n"))]
                found = [(x, i) for x, i in found if x]
                hashes.append([digest(x) - (1 << 63) for x, _ in found])
                words.append([len(x.split()) for x, _ in found])
                places.append([i for _, i in found])
            met = [sorted(set(windows(h, n, blocks.min_words).values())) for h, n in zip(hashes, words)]
            arrays = [*batch.columns[:2], *[pa.array(x, t) for x, t in zip((hashes, words, places, met), types[2:])]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "hashes", "words", "places", "windows"])

    source = docs.where("doc_id is not null").select("doc_id", text_hash().alias("text_hash"), F.col("text").cast("binary").alias("raw"))
    return source.mapInArrow(run, schema)


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def overlaps(held: DataFrame) -> DataFrame:
    """``doc_id, text_hash, first_id, first_hash``: documents and the earlier ones that they are aligned with."""
    each = held.select("doc_id", "text_hash", F.explode("windows").alias("hash"))
    me = F.struct("doc_id", "text_hash")
    shared = each.groupBy("hash").agg(F.min(me).alias("first"), F.max(me).alias("last")).where("first != last").select("hash", "first")
    met = each.join(cut(shared), "hash").drop("hash")  # written, so that the join can split a window that many documents hold
    return (met.where(F.col("first") != me).select("doc_id", "text_hash", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
            .distinct())


def repeated(docs: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """``doc_id, text_hash, removed`` (line numbers from 0) and ``removed_words`` of the documents that lose lines."""
    held = cut(lines(docs, blocks).dropDuplicates(["doc_id", "text_hash"]))
    pairs = cut(overlaps(held))
    first = held.select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"), F.col("hashes").alias("first_hashes"),
                        F.col("windows").alias("first_windows"))
    work = pairs.join(held, ["doc_id", "text_hash"]).join(first, ["first_id", "first_hash"])
    work = work.select("doc_id", "text_hash", "hashes", "words", "places", "first_hashes", "first_windows")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "text_hash": [], "place": [], "n": []}
            for row in batch.to_pylist():
                for y in common_blocks(row["first_hashes"], row["hashes"], row["words"], blocks.min_words, row["first_windows"]):
                    for name, value in zip(out, (row["doc_id"], row["text_hash"], row["places"][y], row["words"][y])):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                             names=list(out))

    found = work.mapInArrow(run, "doc_id long, text_hash long, place int, n int")
    once = found.groupBy("doc_id", "text_hash", "place").agg(F.max("n").alias("n"))
    return once.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("place")).alias("removed"), F.sum("n").alias("removed_words"))


def without_repeats(docs: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """``doc_id, text, n_lines, removed, removed_words``: every row of ``docs`` with its remaining text.

    ``removed`` lists the deleted lines of the whole text, counted from 0.  NULL stays NULL, and a text
    whose every line was deleted becomes empty.
    """
    found = cut(repeated(docs, blocks))
    rows = docs.select("doc_id", "text").withColumn("text_hash", text_hash())
    met = rows.join(found.hint("merge"), ["doc_id", "text_hash"], "left")  # grows with the corpus: the same plan at every size
    none = F.array().cast("array<int>")
    split = F.split("text", "\n")
    rest = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("removed", i)), "\n")
    return met.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest).alias("text"),
                      F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
                      F.coalesce("removed", none).alias("removed"), F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"))
