"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period q and at least 2q words that no neighbouring word
extends keeping the period.  Runs are found at dyadic scales t = 1, 2, 4, ..., each for the periods
from 3t - 1 to 6t - 2:

* *Synchronising positions.*  Every stretch of t words has a hash.  A position i is chosen if the least
  hash of the stretches that begin in [i, i + t], leaving out highly periodic ones, stands at i or i + t.
  That depends on the 2t words from i alone, so equal contexts are chosen alike, and every t positions
  hold a chosen one unless 3t - 1 words there have a period of t / 3 or less.
* *Pairs.*  A run holds a chosen position and, one period on, its equal context.  Two chosen positions with
  equal contexts of 2t words at a distance within the scale propose their distance as a period.  Contexts are
  not highly periodic, so a position has few such partners (18 at most), and all of them are taken.
* *Highly periodic regions.*  A run without a chosen position consists of two regions of one smaller period p
  that touch or overlap, which lower scales have found.  The turn by which their roots match gives the
  period modulo p; every period that leaves two full turns in the regions is proposed.  Period 1 is read
  off directly.

Every proposal is extended to both sides by halving steps over prefix fingerprints, and stretches found
with several periods keep the smallest.  At last every run is compared word by word; should
fingerprints have collided, the work is done again with others.  Documents are processed
many at a time, as one sequence with unlike separators, in classes of similar length.

``mark`` returns one row per row of its input, NULL ids included.  NULL and empty texts have no words, no
runs and an empty collapsed text.  Texts of any length are taken whole; memory grows with the longest text.
Repeated rows each get their result.  An empty table gives an empty result.  Only ``doc_id`` and
the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fellscape.llm.common import binary_rows

SHORTEST = 12
PRIMES = (2_147_483_647, 2_147_483_629)
NEVER = np.int64(1 << 62)  # above every fingerprint
CHUNK_WORDS = 1 << 18
BATCH_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Sequence:
    """Word codes with fingerprints of any stretch from prefix sums."""

    def __init__(self, codes: np.ndarray, longest: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.codes, self.n = codes, len(codes)
        self.step = 1 << max(longest - 1, 0).bit_length()
        self.tables = []
        for prime in PRIMES:
            base = int(rng.integers(prime // 4, prime - 1))
            powers, filled = np.ones(self.n + 1, np.uint64), 1
            while filled <= self.n:
                more = min(filled, self.n + 1 - filled)
                powers[filled:filled + more] = powers[:more] * np.uint64(pow(base, filled, prime)) % np.uint64(prime)
                filled += more
            terms = (codes.astype(np.uint64) + np.uint64(1)) * powers[:-1] % np.uint64(prime)
            self.tables.append((np.uint64(prime), powers, np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(prime)))))

    def prints(self, start: np.ndarray, length) -> np.ndarray:
        """Fingerprints of ``length`` words from each start, comparable across places."""
        out = np.zeros(len(start), np.uint64)
        for prime, powers, sums in self.tables:
            out = out << np.uint64(31) | (sums[start + length] + prime - sums[start]) * powers[self.n - start] % prime
        return out.astype(np.int64)

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are equal from ``a`` and from ``b`` on, a < b."""
        length, step = np.zeros(len(a), np.int64), self.step
        while step:
            i = np.flatnonzero(b + length + step <= self.n)
            at = length[i]
            length[i[self.prints(a[i] + at, step) == self.prints(b[i] + at, step)]] += step
            step >>= 1
        return length

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are equal just before ``a`` and ``b``, a < b."""
        length, step = np.zeros(len(a), np.int64), self.step
        while step:
            i = np.flatnonzero(a - length - step >= 0)
            at = length[i] + step
            length[i[self.prints(a[i] - at, step) == self.prints(b[i] - at, step)]] += step
            step >>= 1
        return length


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` of items: the owner of each item and its number within the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, size = values, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    m = len(values) - width + 1
    return np.minimum(out[:m], out[width - size:][:m])


def smallest(runs: np.ndarray) -> np.ndarray:
    """Rows ``start, end, period`` with the smallest period of each stretch."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    return runs[new]


def of_period_one(codes: np.ndarray) -> np.ndarray:
    edges = np.diff(np.concatenate(([0], (codes[1:] == codes[:-1]).astype(np.int8), [0])))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
    return np.column_stack((start, end, np.ones(len(start), np.int64)))


def synchronised(text: Sequence, runs: np.ndarray, t: int) -> np.ndarray:
    """Synchronising positions of scale ``t``, ascending."""
    m = text.n - 2 * t + 1
    if m <= 0:
        return np.empty(0, np.int64)
    values = text.prints(np.arange(text.n - t + 1), t)
    regions = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    if len(regions):
        edges = np.zeros(len(values) + 1, np.int64)
        np.add.at(edges, regions[:, 0], 1)
        np.add.at(edges, regions[:, 1] - t + 1, -1)
        values = np.where(np.cumsum(edges[:-1]) > 0, NEVER, values)
    least = least_of(values, t + 1)
    return np.flatnonzero((least < NEVER) & ((least == values[:m]) | (least == values[t:t + m])))


def paired(text: Sequence, at: np.ndarray, t: int) -> Iterator[np.ndarray]:
    """``position, period`` of equal contexts at a distance within the scale."""
    contexts = text.prints(at, 2 * t)
    order = np.argsort(contexts, kind="stable")
    at, contexts = at[order], contexts[order]
    i, shift = np.arange(len(at)), 1
    while len(i := i[i + shift < len(at)]):
        apart = at[i + shift] - at[i]
        near = (contexts[i + shift] == contexts[i]) & (apart <= 6 * t - 2)
        i, apart = i[near], apart[near]
        fits = apart >= 3 * t - 1
        yield np.column_stack((at[i[fits]], apart[fits]))
        shift += 1


def touching(text: Sequence, runs: np.ndarray, t: int) -> np.ndarray:
    """``position, period`` that two touching regions of one small period propose."""
    low, high = 3 * t - 1, 6 * t - 2
    own = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= low)]
    own = own[np.lexsort((own[:, 0], own[:, 2]))]
    one, two = own[:-1], own[1:]
    meet = (one[:, 2] == two[:, 2]) & (one[:, 1] >= two[:, 0])
    one, two = one[meet], two[meet]
    (a, b, p), (c, d) = one.T, two[:, :2].T
    k, turn = spans(p)
    x = b[k] - 2 * p[k] + turn
    same = text.prints(x, p[k]) == text.prints(c[k], p[k])
    k, x = k[same], x[same]
    a, b, c, d, p = a[k], b[k], c[k], d[k], p[k]
    first = low + (c - x - low) % p
    last = np.minimum.reduce([b - a, (d - a) // 2, d - c, np.full(len(a), high)])
    k, turn = spans(np.maximum((last - first) // p + 1, 0))
    period = first[k] + turn * p[k]
    return np.column_stack((np.maximum(a[k], c[k] - period), period))


def candidates(codes: np.ndarray, longest: int, seed: int) -> np.ndarray:
    """Rows ``start, end, period`` of all runs, of any length."""
    text = Sequence(codes, longest, seed)
    runs, t = of_period_one(codes), 1
    while 2 * (3 * t - 1) <= longest:
        proposed = np.concatenate([np.empty((0, 2), np.int64), *paired(text, synchronised(text, runs, t), t), touching(text, runs, t)])
        i, q = proposed.T
        start, end = i - text.before(i, i + q), i + q + text.after(i, i + q)
        full = end - start >= 2 * q
        runs = smallest(np.concatenate((runs, np.column_stack((start, end, q))[full])))
        t *= 2
    return runs


def proven(codes: np.ndarray, runs: np.ndarray) -> bool:
    """Whether every row is periodic and cannot be extended, word by word."""
    start, end, q = runs.T
    for k in range(0, len(runs), 4096):
        own, step = spans((end - start - q)[k:k + 4096])
        at = start[k:k + 4096][own] + step
        if not np.array_equal(codes[at], codes[at + q[k:k + 4096][own]]):
            return False
    left, right = np.flatnonzero(start > 0), np.flatnonzero(end < len(codes))
    return bool(np.all(codes[start[left] - 1] != codes[start[left] - 1 + q[left]]) and np.all(codes[end[right]] != codes[end[right] - q[right]]))


def runs_of(documents: list[np.ndarray], vocabulary: int, shortest: int = SHORTEST) -> list[np.ndarray]:
    """``start, length, period`` of the runs of each document of word codes, by start and period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    breaks = vocabulary + np.arange(len(documents))
    codes = np.concatenate([x for d, k in zip(documents, breaks) for x in (d, [k])]).astype(np.int64)
    seed = 0
    while True:
        runs = candidates(codes, int(sizes.max()), seed)
        runs = runs[runs[:, 1] - runs[:, 0] >= shortest]
        if proven(codes, runs):
            break
        seed += 1
    first = np.cumsum(sizes + 1) - sizes - 1
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    rows = np.column_stack((runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2]))
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], owner))]
    return np.split(rows, np.cumsum(np.bincount(owner, minlength=len(documents)))[:-1])


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(edges[:-1]) == 0)


def all_runs(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """Runs of many lists of words; lists of similar length are searched together."""
    codes: dict[bytes, int] = {}
    none = np.empty((0, 3), np.int64)
    out, classes = [none] * len(texts), {}
    for i, words in enumerate(texts):
        if len(words) >= shortest:
            classes.setdefault(len(words).bit_length(), []).append(i)
    for members in classes.values():
        chunk, size = [], 0
        for i in [*members, -1]:
            if chunk and (i < 0 or size + len(texts[i]) > CHUNK_WORDS):
                own = [np.array([codes.setdefault(w, len(codes)) for w in texts[k]], np.int64) for k in chunk]
                for k, rows in zip(chunk, runs_of(own, len(codes), shortest)):
                    out[k] = rows
                chunk, size = [], 0
            if i >= 0:
                chunk.append(i)
                size += len(texts[i])
    return out


def mark(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``, a row per row of ``docs``.

    ``runs`` are all runs of at least ``shortest`` words by start and period.  ``collapsed`` are the words that
    no run holds after its first period, joined by one space.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            texts = [(t.as_py() or b"").split() for t in batch.column("raw")]
            found = all_runs(texts, shortest)
            rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], names=["start", "length", "period"])
            ends = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
            left = [b" ".join(w if not len(r) else [w[k] for k in kept(len(w), r)]) for w, r in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs),
                 pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias("raw")).mapInArrow(run, SCHEMA)
