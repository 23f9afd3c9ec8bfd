"""Katz back-off bigram model, trained on a corpus and evaluated on all of it.

``P(w | h)`` is the Good-Turing discounted relative frequency of a bigram seen in training, and otherwise
``alpha(h) * P(w)``, where ``alpha(h)`` is exactly the mass that the discounts leave to ``h`` divided by the
unigram mass of the words not seen after ``h``.  Unigrams are discounted the same way and leave their mass
to one unknown word.  Every text starts from a begin mark, which is only a history, and closes with an end
token.  A history whose discounts leave nothing is given ``c(h) + 1`` as denominator.

Rows of single n-grams would be far more bytes than the texts, so tasks exchange packed columns:

1. Texts become *chunks* of up to ``CHUNK_TOKENS`` tokens: a local vocabulary of 64-bit word hashes and
   positions into it, written once to the shared folder.
2. Each chunk sends its distinct words with their local counts to the partitions of the unigram table, and
   gets back global counts and word numbers.
3. Each chunk sends its distinct bigrams to the partitions of the bigram table, which are dealt by
   history (by history and word for a frequent history, ``SPLIT`` tokens to a part).  A partition sums the
   counts and returns those that were asked for, with what each history needs for its back-off weight:
   the number of its successors by count and the unigram mass of its successors.
4. Each chunk scores its tokens: bigram, else back-off weight and unigram, else unknown word.

A word or bigram goes through an exchange once per chunk, however frequent it is.  Both tables stay
partitioned; chunks and partitions have bounded size (but for a single text above the chunk size).

NULL texts count as empty, and an empty text is its end alone.  Texts are taken whole.  Repeated rows are trained on and scored as often as they come; a
NULL id counts as a training row.  An empty table gives an empty result; without training rows all scores are 0.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fellscape.llm.common import binary_rows
from fellscape.session import cut, task_count

CHUNK_TOKENS = 2_000_000
SPLIT = 500_000
WORDS_PER_PART, BIGRAMS_PER_PART = 1_000_000, 1_500_000
TOP = 5  # counts up to this are discounted
END, BEGIN = 0, 1  # reserved word hashes
BATCH_BYTES = 8 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Numeric arrays, byte plane by byte plane, compressed."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a))]], np.int64).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8:8 + 24 * count].view(np.int64).reshape(count, 3), 8 + 24 * count, []
    for kind, width, n in head.tolist():
        plane = raw[at:at + width * n].reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(np.dtype(f"{chr(kind)}{width}")))
        at += width * n
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """Part by the leading bits: parts are ranges of the number."""
    return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def discounts(counts: Sequence[int], top: int = TOP) -> np.ndarray:
    """Factors for the counts 1 to ``top`` from ``n_1 .. n_{top+1}``.

    Good-Turing with the largest ``k <= top`` for which all factors lie between 0 and 1; counts above ``k``
    are kept.  Where no ``k`` does, absolute discounting with ``n_1 / (n_1 + 2 n_2)``, or one half.
    """
    n = [0, *map(int, counts)]
    for k in range(top, 1, -1):
        if min(n[1:k + 2]) > 0:
            a = (k + 1) * n[k + 1] / n[1]
            if a < 1:
                d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    return np.array(d + [1.0] * (top - k))
    b = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.array([(r - b) / r for r in range(1, top + 1)])


@dataclass(frozen=True)
class Unigrams:
    """What is known of the unigram table as a whole."""

    tokens: int
    words: int
    factors: tuple[float, ...]
    unknown: float
    total: int

    @classmethod
    def of(cls, counts: Sequence[int], tokens: int, words: int) -> Unigrams:
        d = discounts(counts)
        left = sum((1 - d[r - 1]) * r * counts[r - 1] for r in range(1, TOP + 1))
        if left > 0:
            return cls(tokens, words, tuple(d), left / tokens, tokens)
        return cls(tokens, words, (1.0,) * TOP, 1 / (tokens + 1), tokens + 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        factor = np.array([1.0, *self.factors, 1.0])[np.minimum(count, TOP + 1).astype(np.int64)]
        return np.where(count > 0, factor * count / max(self.total, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


class Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


CHUNKS = "chunk long, ids array<long>, train binary, lengths binary, vocabulary binary, tokens binary, n_tokens long, n_words long"


def training_row(doc_id: Column) -> Column:
    """All but one in five rows, by id; rows without an id are training rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def chunks(docs: DataFrame) -> DataFrame:
    """The tokenised corpus, a row per chunk of whole texts."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def row(chunk: int, ids: list, train: list, lengths: list, found: list[np.ndarray], index: Index) -> pa.RecordBatch:
        local = np.concatenate([*found, np.empty(0, np.uint32)])
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, len(index))
        hashes[hashes <= BEGIN] += np.uint64(2)
        hashes, same = np.unique(hashes, return_inverse=True)
        local = same[local]
        used = np.bincount(local, minlength=len(hashes))
        order = np.argsort(-used, kind="stable")  # small positions for frequent words
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        values = [[chunk], [ids], [pack(np.array(train, np.uint8))], [pack(np.array(lengths, np.uint32))], [pack(hashes[order])],
                  [pack(place[local])], [len(local) + len(ids)], [len(hashes)]]
        types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, train, lengths, found, index, n = [], [], [], [], Index(), 0
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            for doc_id, is_train, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = (text or b"").lower().split()
                if ids and n + len(words) > CHUNK_TOKENS:
                    yield row(chunk, ids, train, lengths, found, index)
                    chunk += 1
                    ids, train, lengths, found, index, n = [], [], [], [], Index(), 0
                ids.append(doc_id)
                train.append(is_train)
                lengths.append(len(words))
                found.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                n += len(words) + 1
        if ids:
            yield row(chunk, ids, train, lengths, found, index)

    source = docs.select("doc_id", training_row(F.col("doc_id")).cast("int").alias("train"), F.col("text").cast("binary").alias("raw"))
    return source.mapInArrow(run, CHUNKS)


@dataclass
class Chunk:
    """A chunk's tokens as ``history -> word`` pairs of positions in its vocabulary, marks included."""

    id: int
    ids: pa.Array
    train: np.ndarray
    lengths: np.ndarray
    vocabulary: np.ndarray  # hashes, then END and BEGIN
    history: np.ndarray
    word: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        (train,), (lengths,), (vocabulary,), (tokens,) = (unpack(row[c]) for c in ("train", "lengths", "vocabulary", "tokens"))
        n, sizes = len(vocabulary), lengths.astype(np.int64) + 1
        last = np.cumsum(sizes) - 1
        word = np.full(int(sizes.sum()), n, np.int64)  # END
        inner = np.ones(len(word), bool)
        inner[last] = False
        word[inner] = tokens
        history = np.empty_like(word)
        history[1:] = word[:-1]
        history[last - sizes + 1] = n + 1  # BEGIN
        marks = np.array([END, BEGIN], np.uint64)
        return cls(row["chunk"], row["ids"], train, lengths, np.concatenate((vocabulary, marks)), history, word,
                   np.repeat(np.arange(len(sizes)), sizes))

    def word_counts(self) -> np.ndarray:
        """Training occurrences of the vocabulary; of BEGIN as a history."""
        in_train = self.train[self.doc] > 0
        counts = np.bincount(self.word[in_train], minlength=len(self.vocabulary))
        counts[-1] = int(self.train.sum())
        return counts

    def words_by_part(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """Positions of the vocabulary that go to each part, by hash."""
        order = np.argsort(self.vocabulary)
        part = part_of(self.vocabulary[order], parts)
        edges = np.searchsorted(part, np.arange(parts + 1))
        for p in np.unique(part):
            yield int(p), order[edges[p]:edges[p + 1]]

    def bigrams(self, number: np.ndarray, count: np.ndarray, parts: int) -> Bigrams:
        """Distinct bigrams in the order in which they are sent; ``number, count`` are the vocabulary's from the unigram table."""
        n = len(self.vocabulary)
        pairs, which, uses = np.unique(self.history * n + self.word, return_inverse=True, return_counts=True)
        seen = np.bincount(which, self.train[self.doc], len(pairs)).astype(np.int64)
        h, w = pairs // n, pairs % n
        asked = np.zeros(n, bool)
        asked[h[seen < uses]] = True  # held-out texts may need the back-off weight
        pieces = count // SPLIT + 1
        sub = (mix(number[w]) % pieces[h].astype(np.uint64)).astype(np.int64)
        # a history in several pieces is asked for in all of them
        used = np.unique(h)
        many = used[pieces[used] > 1]
        all_h = np.concatenate([used[pieces[used] == 1], np.repeat(many, pieces[many])])
        all_sub = np.concatenate([np.zeros(len(used) - len(many), np.int64), *[np.arange(p) for p in pieces[many]]])
        place = lambda h, s: part_of(mix(number[h] * np.uint64(0x9E3779B97F4A7C15) + s.astype(np.uint64)), parts)
        ask_part = place(all_h, all_sub)
        order = np.lexsort((all_sub, number[all_h], ask_part))
        all_h, all_sub, ask_part = all_h[order], all_sub[order], ask_part[order]
        # rank of each (history, piece) orders the bigrams the same way
        base = np.zeros(n + 1, np.int64)
        np.cumsum(pieces, out=base[1:])
        rank = np.empty(base[-1], np.int64)
        rank[base[all_h] + all_sub] = np.arange(len(all_h))
        group = rank[base[h] + sub]
        by = np.lexsort((number[w], group))
        return Bigrams(h[by], w[by], seen[by], group[by], np.argsort(by)[which], all_h, ask_part, asked[all_h])


@dataclass
class Bigrams:
    history: np.ndarray
    word: np.ndarray
    train: np.ndarray
    group: np.ndarray  # row of ``asked_history``
    of_token: np.ndarray
    asked_history: np.ndarray
    part: np.ndarray
    asked: np.ndarray

    def by_part(self, parts: int) -> Iterator[tuple[int, slice, slice]]:
        """Ranges of the histories and of the bigrams that go to each part."""
        edges = np.searchsorted(self.part, np.arange(parts + 1))
        bounds = np.searchsorted(self.group, edges)
        for p in np.unique(self.part):
            yield int(p), slice(edges[p], edges[p + 1]), slice(bounds[p], bounds[p + 1])


def table_of(rows: list[dict], schema: Sequence[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema(schema))


SENT = (("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary()))
ANSWER = (("chunk", pa.int64()), ("part", pa.int32()), ("level", pa.int32()), ("data", pa.binary()), ("stats", pa.list_(pa.int64())))
SENT_SQL = "part int, chunk long, data binary"
ANSWER_SQL = "chunk long, part int, level int, data binary, stats array<long>"


def send_words(corpus: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk.of(row)
                counts = c.word_counts().astype(np.uint64)
                rows = [{"part": p, "chunk": c.id, "data": pack(c.vocabulary[own], counts[own])} for p, own in c.words_by_part(parts)]
                yield from table_of(rows, SENT).to_batches()

    return corpus.mapInArrow(run, SENT_SQL)


def count_words(sent: pa.Table) -> pa.Table:
    """A part of the unigram table: the answers to each chunk, and the part's totals."""
    part, blocks = sent["part"][0].as_py(), [unpack(x.as_py()) for x in sent["data"]]
    keys, which = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    total = np.bincount(which, np.concatenate([b[1] for b in blocks]).astype(np.float64), len(keys)).astype(np.uint64)
    out, at = [], 0
    for chunk, (own, _) in zip(sent["chunk"], blocks):
        mine = which[at:at + len(own)]
        at += len(own)
        out.append({"chunk": chunk.as_py(), "part": part, "level": 1, "data": pack(total[mine], mine.astype(np.uint32)), "stats": None})
    real = total[(total > 0) & (keys != BEGIN)]
    by_count = np.bincount(np.minimum(real, TOP + 2).astype(np.int64), minlength=TOP + 3)[1:TOP + 2]
    out.append({"chunk": None, "part": part, "level": 1, "data": None, "stats": [*by_count.tolist(), int(real.sum()), len(real)]})
    return table_of(out, ANSWER)


def global_words(c: Chunk, answers: dict[int, list[np.ndarray]], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and training count of the chunk's vocabulary."""
    number, count = np.zeros(len(c.vocabulary), np.uint64), np.zeros(len(c.vocabulary), np.int64)
    for p, own in c.words_by_part(parts):
        total, index = answers[p]
        count[own] = total.astype(np.int64)
        number[own] = (np.uint64(p) << np.uint64(32)) + index.astype(np.uint64)
    return number, count


def answers_of(table: pa.Table) -> dict[int, dict[int, list[np.ndarray]]]:
    found: dict[int, dict[int, list[np.ndarray]]] = {1: {}, 2: {}}
    for level, part, data in zip(table["level"].to_pylist(), table["part"].to_pylist(), table["data"]):
        found[level][part] = unpack(data.as_py())
    return found


def send_bigrams(corpus: DataFrame, words: DataFrame, word_parts: int, parts: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            c = Chunk.of(row)
            number, count = global_words(c, answers_of(right)[1], word_parts)
            b = c.bigrams(number, count, parts)
            sizes = np.bincount(b.group, minlength=len(b.asked_history))
            for p, histories, pairs in b.by_part(parts):
                rows.append({"part": p, "chunk": c.id, "data": pack(
                    number[b.asked_history[histories]], sizes[histories].astype(np.uint32), b.asked[histories].astype(np.uint8),
                    number[b.word[pairs]], count[b.word[pairs]].astype(np.uint64), b.train[pairs].astype(np.uint32))})
        return table_of(rows, SENT)

    return corpus.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(run, SENT_SQL)


def count_bigrams(unigrams: Unigrams):
    def run(sent: pa.Table) -> pa.Table:
        """A part of the bigram table: counts and the histories' sums for each chunk, and the part's totals."""
        part, blocks = sent["part"][0].as_py(), [unpack(x.as_py()) for x in sent["data"]]
        histories, h = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
        words, w = np.unique(np.concatenate([b[3] for b in blocks]), return_inverse=True)
        of_pair = np.repeat(h, np.concatenate([b[1] for b in blocks]))
        keys, which = np.unique(of_pair * max(1, len(words)) + w, return_inverse=True)
        total = np.bincount(which, np.concatenate([b[5] for b in blocks]), len(keys)).astype(np.int64)
        mass = np.zeros(len(words))
        mass[w] = unigrams.p(np.concatenate([b[4] for b in blocks]))
        seen = total > 0
        owner, c = keys[seen] // max(1, len(words)), total[seen]
        covered = np.bincount(owner, mass[keys[seen] % max(1, len(words))], len(histories))
        low = [np.bincount(owner[c == r], minlength=len(histories)).astype(np.uint32) for r in range(1, TOP + 1)]
        present = sum(((x > 0).astype(np.uint8) << r for r, x in enumerate(low)), np.zeros(len(histories), np.uint8))
        out, at, at_h = [], 0, 0
        for chunk, b in zip(sent["chunk"], blocks):
            own, mine = h[at_h:at_h + len(b[0])], which[at:at + len(b[3])]
            at, at_h = at + len(b[3]), at_h + len(b[0])
            asked = own[b[2] > 0]
            data = pack(total[mine].astype(np.uint64), present[own], covered[asked], *[x[asked] for x in low])
            out.append({"chunk": chunk.as_py(), "part": part, "level": 2, "data": data, "stats": None})
        by_count = np.bincount(np.minimum(c, TOP + 2), minlength=TOP + 3)[1:TOP + 2]
        out.append({"chunk": None, "part": part, "level": 2, "data": None, "stats": by_count.tolist()})
        return table_of(out, ANSWER)

    return run


SCORES = (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
          ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))
SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def log_probabilities(c: Chunk, b: Bigrams, count: np.ndarray, answers: dict[int, list[np.ndarray]], unigrams: Unigrams,
                      factors: np.ndarray, parts: int) -> np.ndarray:
    """log10 P(word | history) of each of the chunk's distinct bigrams."""
    n = len(c.vocabulary)
    total = np.zeros(len(b.word), np.int64)
    covered, left, present = np.zeros(n), np.zeros(n), np.zeros(n, np.uint8)
    for p, histories, pairs in b.by_part(parts):
        got, bits, mass, *by_count = answers[p]
        total[pairs] = got.astype(np.int64)
        own = b.asked_history[histories]
        np.bitwise_or.at(present, own, bits)
        asked = own[b.asked[histories]]
        np.add.at(covered, asked, mass)
        for r, x in enumerate(by_count, 1):
            np.add.at(left, asked, (1 - factors[r - 1]) * r * x)
    h, seen = b.history, total > 0
    giving = sum(1 << r for r, d in enumerate(factors) if d < 1)  # counts whose discount leaves something
    nothing_left = present & giving == 0
    denominator = np.maximum(count + nothing_left, 1)
    left = np.where(nothing_left, 1.0, left)
    factor = np.concatenate(([1.0], factors, [1.0]))[np.minimum(total, TOP + 1)]
    direct = factor * total / denominator[h]
    weight = np.where(count[h] > 0, left[h] / denominator[h] / np.maximum(1 - covered[h], 1e-300), 1.0)
    return np.log10(np.where(seen, direct, weight * unigrams.p(count[b.word])))


def score_chunks(corpus: DataFrame, answers: DataFrame, word_parts: int, parts: int, unigrams: Unigrams, factors: np.ndarray) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            c, found = Chunk.of(row), answers_of(right)
            number, count = global_words(c, found[1], word_parts)
            b = c.bigrams(number, count, parts)
            logs = log_probabilities(c, b, count, found[2], unigrams, factors, parts)
            n, sums = len(c.ids), lambda x: np.bincount(c.doc, x, len(c.ids))
            known = count[c.word]
            tables.append(pa.table([pa.array(c.ids, pa.int64()), pa.array(c.train == 0), pa.array(c.lengths.astype(np.int64) + 1),
                                    pa.array(sums(known > 0).astype(np.int64)), pa.array(np.full(n, unigrams.tokens, np.int64)),
                                    pa.array(sums(unigrams.base(known))), pa.array(sums(logs[b.of_token]))], schema=pa.schema(SCORES)))
        return pa.concat_tables(tables) if tables else table_of([], SCORES)

    return corpus.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORES_SQL)


def totals(answers: DataFrame) -> list[int]:
    """Element-wise sum of the parts' statistics."""
    rows = answers.where("stats is not null").select(F.posexplode("stats").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    return [r["n"] for r in sorted(rows, key=lambda r: r["i"])]


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row per row of ``docs``.

    NULL and empty texts are their end token.  Without training rows all words are unknown.  Repeated
    rows count as often as they occur.  ``base_score`` is the unigram score with half added to each count.
    """
    spark = docs.sparkSession
    corpus = cut(chunks(docs))
    tokens, words = corpus.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    if not tokens:
        return spark.createDataFrame([], SCORES_SQL)
    least = task_count(spark)
    word_parts = max(least, math.ceil(words / WORDS_PER_PART))
    parts = max(least, math.ceil(tokens / BIGRAMS_PER_PART))
    unigram_table = cut(send_words(corpus, word_parts).groupBy("part").applyInArrow(count_words, ANSWER_SQL))
    *by_count, n, v = totals(unigram_table)
    unigrams = Unigrams.of(by_count, n, v)
    word_answers = unigram_table.where("chunk is not null")
    bigram_table = cut(send_bigrams(corpus, word_answers, word_parts, parts).groupBy("part").applyInArrow(count_bigrams(unigrams), ANSWER_SQL))
    factors = discounts(totals(bigram_table))
    answers = word_answers.unionAll(bigram_table.where("chunk is not null"))
    return score_chunks(corpus, answers, word_parts, parts, unigrams, factors)
