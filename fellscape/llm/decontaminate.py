"""Benchmark decontamination on canonical templates, which also finds re-parameterised questions.

*Template.*  Numbers, units and names become typed placeholders; other words are lower-cased and lose
punctuation at their edges; tokens of punctuation alone are left out.  A name is a capitalised word
that does not begin a sentence or line.

*Windows.*  Every window of ``WINDOW`` template tokens with at least ``MIN_LITERALS`` plain words is
hashed.  An item shorter than a window is one window of its own length; an item with fewer plain
words than ``MIN_LITERALS`` cannot be told from chance and matches nothing.

*Join.*  Document windows meet item windows by hash.  A bit table over the hashes of the benchmark, of
bounded size, keeps windows that match nothing from being shuffled; what passes it is joined exactly.

*Slots.*  Along one alignment of a document and an item, the fillings of the placeholders must map one
to one: the same value of the item always meets the same value of the document and the other
way round.  Alignments with equal fillings are ``exact``, others ``reparameterised``.

NULL and empty texts and items hold nothing.  Texts are taken whole, however long.  Rows that repeat an id are judged together, rows without
one stay in ``clean`` and are not reported.  Of alignments with equally many windows an exact one counts.  An empty table or benchmark gives an empty
result.  Of ``docs`` only ``doc_id`` and ``text`` are read; ``clean`` returns all its columns as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fellscape.llm.common import binary_rows, broadcast_if_small, in_batches
from fellscape.session import cut

WINDOW, MIN_LITERALS = 8, 4
BATCH_BYTES = 1 << 20
MEMO_WORDS = 200_000
MAX_TABLE_BITS = 28

# Words that stand for numbers and units of measure.
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                         "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs oz "
                  "ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
                  "week weeks month months year years percent % degree degrees dollar dollars cent cents euro euros meter meters "
                  "metre metres mph kmh".split())
NUMBER = re.compile(r"[+\-$€£]*[.]?\d")
EDGES = re.compile(r"^[^\w%$€£+\-]+|[^\w%]+$")

CAPITAL, ENDS, DROPPED, NUM, UNIT, NAME = 1, 2, 4, 8, 16, 24
FLAGS = 31


@dataclass(frozen=True)
class Limits:
    """An item is found when this many of its windows, or this share of them, match along one alignment."""

    windows: int = 6
    share: float = 0.5


class Codes(dict):
    """Hash and flags of a word as one integer; forgets everything when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        core = EDGES.sub("", word)
        flags = ENDS if word.rstrip("\"')]»”").endswith((".", "!", "?", ":", "|")) else 0
        low = core.lower()
        if not any(c.isalnum() or c == "%" for c in core):
            flags |= DROPPED
        elif NUMBER.match(core) or low in NUMBER_WORDS:
            flags |= NUM
        elif low in UNITS:
            flags |= UNIT
        elif core[0].isupper() and len(core) > 1 and not core.isupper():
            flags |= CAPITAL
        code = xxhash.xxh64_intdigest(low.encode()) & ~FLAGS | flags
        self[word] = code
        return code


@dataclass
class Tokens:
    """Template tokens of a run of texts."""

    value: np.ndarray  # hash of the word, or the placeholder's type
    kind: np.ndarray  # 0: plain word
    owner: np.ndarray  # text number
    place: np.ndarray  # position in its text
    word: list[str]


def tokens(texts: Sequence[bytes | None], codes: Codes) -> Tokens:
    words, line_starts, counts = [], [], []
    for t in texts:
        before = len(words)
        for line in (t or b"").decode("utf-8", "replace").split("\n"):
            line_starts.append(len(words))
            words += line.split()
        counts.append(len(words) - before)
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    flags = (code & np.uint64(FLAGS)).astype(np.int64)
    begins = np.zeros(len(words) + 1, bool)
    begins[line_starts] = True
    begins[1:] |= np.append((flags & ENDS) > 0, False)[:len(words)]
    kind = flags & NAME
    kind[((flags & CAPITAL) > 0) & ~begins[:-1]] = NAME
    kept = np.flatnonzero((flags & DROPPED) == 0)
    owner = np.repeat(np.arange(len(texts)), counts)[kept]
    kind = kind[kept]
    value = np.where(kind > 0, kind.astype(np.uint64), code[kept] & ~np.uint64(FLAGS))
    first = np.searchsorted(owner, owner)
    return Tokens(value, kind, owner, np.arange(len(kept)) - first, [words[i] for i in kept])


def window_hashes(t: Tokens, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the windows of ``length`` tokens inside one text with enough plain words."""
    n = len(t.value) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = (h ^ t.value[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    plain = np.concatenate(([0], np.cumsum(t.kind == 0)))
    good = (t.owner[:n] == t.owner[length - 1:]) & (plain[length:] - plain[:n] >= MIN_LITERALS)
    at = np.flatnonzero(good)
    return at, h[at]


def fillings(t: Tokens, start: int, length: int) -> list[str]:
    """Values of the placeholders of a window, in order."""
    return [EDGES.sub("", t.word[i]).lower() for i in range(start, start + length) if t.kind[i]]


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, at, length, hash, slots, windows`` for every window of every item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            ids, out = batch.column("item_id").to_pylist(), []
            t = tokens(batch.column("raw").to_pylist(), codes)
            sizes = np.bincount(t.owner, minlength=len(ids))
            for length in sorted({min(WINDOW, int(s)) for s in sizes if s >= MIN_LITERALS}):
                at, h = window_hashes(t, length)
                own = (sizes[t.owner[at]] == length) | (length == WINDOW)
                at, h = at[own], h[own]
                total = np.bincount(t.owner[at], minlength=len(ids))
                out += [(ids[t.owner[i]], int(t.place[i]), length, int(x), fillings(t, i, length), int(total[t.owner[i]]))
                        for i, x in zip(at.tolist(), h.view(np.int64).tolist())]
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "at", "length", "hash", "slots", "windows"), r)) for r in out], schema=pa.schema(
                [("item_id", pa.int64()), ("at", pa.int64()), ("length", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string())), ("windows", pa.int64())]))

    source = items.where("item_id is not null").select("item_id", F.col("text").cast("binary").alias("raw"))
    return source.mapInArrow(run, "item_id long, at long, length int, hash long, slots array<string>, windows long")


def bit_table(windows: DataFrame, count: int) -> np.ndarray:
    """Bits of the hashes' leading digits; at most ``2**MAX_TABLE_BITS`` bits, whatever the benchmark's size."""
    bits = min(MAX_TABLE_BITS, max(16, math.ceil(math.log2(count * 32 + 1))))
    lead = F.shiftrightunsigned("hash", 64 - bits)
    rows = (windows.groupBy(F.shiftrightunsigned(lead, 3).alias("at"))
            .agg(F.bit_or(F.pow(F.lit(2), lead % 8).cast("int")).alias("value")).collect())
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        table[r["at"]] = r["value"] & 255
    return table


def document_windows(docs: DataFrame, table: np.ndarray, lengths: Sequence[int]) -> DataFrame:
    """``doc_id, at, hash, slots`` of the windows whose bit is set."""
    held = docs.sparkSession.sparkContext.broadcast(table)
    shift = np.uint64(64 - (len(table) * 8).bit_length() + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits = Codes(), held.value
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            ids = batch.column("doc_id").to_pylist()
            t = tokens(batch.column("raw").to_pylist(), codes)
            out = []
            for length in lengths:
                at, h = window_hashes(t, length)
                lead = h >> shift
                hit = bits[lead >> np.uint64(3)] >> (lead & np.uint64(7)).astype(np.uint8) & 1 > 0
                out += [{"doc_id": ids[t.owner[i]], "at": int(t.place[i]), "hash": x, "slots": fillings(t, i, length)}
                        for i, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist())]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    source = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return in_batches(source).mapInArrow(run, "doc_id long, at long, hash long, slots array<string>")


def leaks(docs: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, item_id, kind, matched, windows``: one row per document and item found in it.

    NULL and empty texts hold nothing.  Rows that repeat a ``doc_id`` are judged together; rows without
    an id cannot be reported.  Of several alignments the one with most windows counts.
    """
    spark = docs.sparkSession
    theirs = cut(item_windows(items))
    count = theirs.count()
    if not count:
        return spark.createDataFrame([], "doc_id long, item_id long, kind string, matched long, windows long")
    lengths = sorted(r["length"] for r in theirs.select("length").distinct().collect())
    ours = document_windows(docs, bit_table(theirs, count), lengths)
    theirs = theirs.select("hash", "item_id", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "windows")
    met = ours.join(broadcast_if_small(theirs), "hash")
    pairs = F.when(F.size("slots") > 0, F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")))
    lines = (met.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
             .agg(F.size(F.collect_set("item_at")).cast("long").alias("matched"), F.first("windows").alias("windows"),
                  F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")))
    n = F.size("pairs")
    one_to_one = (F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == n) & (
        F.size(F.array_distinct(F.transform("pairs", lambda p: p["d"]))) == n)
    enough = (F.col("matched") >= limits.windows) | (F.col("matched") >= F.ceil(limits.share * F.col("windows")))
    exact = ~F.exists("pairs", lambda p: p["i"] != p["d"])
    best = F.struct("matched", F.when(exact, 1).otherwise(0).alias("exact"))
    return (lines.where(one_to_one & enough).groupBy("doc_id", "item_id")
            .agg(F.max(best).alias("best"), F.first("windows").alias("windows"))
            .select("doc_id", "item_id", F.when(F.col("best.exact") == 1, "exact").otherwise("reparameterised").alias("kind"),
                    F.col("best.matched").alias("matched"), "windows"))


def clean(docs: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents, whole, in which no item was found; rows without an id stay."""
    found = cut(leaks(docs, items, limits).select(F.col("doc_id").alias("leak_id")).distinct())
    return docs.join(broadcast_if_small(found), docs["doc_id"] == found["leak_id"], "left_anti")
