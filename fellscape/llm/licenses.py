"""Licence notices through a positional index of rare words.

*Words* are runs of ASCII letters and digits and of bytes above them, with A-Z lower-cased.

*Base phrases* are counted wherever their words stand consecutively.

*Index.*  The inverse document frequency of every word of a template is counted over all texts.  Each template
posts its rarest words (a third of them, four at least; ties by position) with their positions.

*Lookup.*  The posted words of a text, its rarest licence words, fetch their postings.  A posting at position j
for a word at position i says that the template would begin at i - j.  Postings whose beginnings lie within
``SLACK`` words agree: words put in or left out move the rest by little.  Where the agreeing words, each counted once,
hold at least ``SHARE`` of the weight of the template's posted words, the template is proposed.

*Verification.*  Every mandatory phrase of the template must stand within the proposed place, widened by ``SLACK``
words.  Of proposals that begin within one template's length of each other the heaviest counts, the first of
equals.

``scan`` returns one row per row of its input, NULL ids included and repeated rows each.  NULL and empty texts have no
words, no labels and the score 0.  Texts are taken whole, however long.  An empty table gives an empty
result.  Only ``doc_id`` and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fellscape.llm.common import binary_rows
from fellscape.llm.license_texts import TEMPLATES
from fellscape.llm.periodic import spans

#: Phrases of the base labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
BASE_SCORE = 0.5
SHARE, SLACK = 0.6, 12
POSTED_OF, POSTED_LEAST = 3, 4
BATCH_BYTES = 8 << 20
#: Every byte as it reads within words, other bytes as a space.
READ = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
SCHEMA = ("doc_id long, n_words long, base array<struct<start:long,label:string>>, "
          "matches array<struct<start:long,template:int,label:string,score:double>>")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(READ).split()


@dataclass
class Vocabulary:
    """Word numbers of all templates and phrases."""

    templates: Sequence[tuple[str, str, Sequence[str]]]
    base: Sequence[tuple[str, str]]

    def __post_init__(self) -> None:
        number: dict[bytes, int] = {}
        code = lambda text: np.array([number.setdefault(w, len(number)) for w in words_of(text.encode())], np.int64)
        self.texts = [code(text) for _, text, _ in self.templates]
        self.needs = [[code(p) for p in phrases] for _, _, phrases in self.templates]
        self.phrases = [code(p) for p, _ in self.base]
        self.number = number

    def read(self, texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of texts one after the other, -1 for other words and after each text, and where each begins."""
        get, parts, starts, at = self.number.get, [], [], 0
        for text in texts:
            words = words_of(text)
            parts.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
            parts.append(np.full(1, -1))
            starts.append(at)
            at += len(words) + 1
        return np.concatenate(parts or [np.empty(0, np.int64)]), np.array([*starts, at], np.int64)


def stands(codes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand consecutively."""
    at = np.flatnonzero(codes == phrase[0])
    for k, word in enumerate(phrase[1:], 1):
        at = at[at + k < len(codes)]
        at = at[codes[at + k] == word]
    return at


class Index:
    """Postings of the rarest words of each template."""

    def __init__(self, known: Vocabulary, frequency: np.ndarray, texts: int) -> None:
        self.known = known
        idf = np.log((texts + 1) / (frequency + 1)) + 1e-6  # words of every text keep a little weight
        rows = []
        for t, codes in enumerate(known.texts):
            order = np.lexsort((np.arange(len(codes)), -idf[codes]))
            rarest = order[:max(POSTED_LEAST, -(-len(codes) // POSTED_OF))]
            rows += [(codes[j], t, j) for j in rarest]
        rows = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.template, self.place, self.weight = rows[:, 1], rows[:, 2], idf[rows[:, 0]]
        self.first = np.searchsorted(rows[:, 0], np.arange(len(frequency) + 1))
        self.total = np.bincount(self.template, self.weight, len(known.texts))

    def proposals(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """``document, template, beginning, share`` of every place with enough agreeing words; places count from the first text."""
        size = np.where(codes >= 0, self.first[codes + 1] - self.first[codes], 0)
        at = np.flatnonzero(size)
        k, step = spans(size[at])
        at, posting = at[k], self.first[codes[at[k]]] + step
        doc, template = np.searchsorted(starts, at, side="right") - 1, self.template[posting]
        pair = doc * len(self.total) + template
        # a text that does not hold enough of the words anywhere is done with
        seen, posted = np.divmod(np.unique(pair * len(self.weight) + posting), max(len(self.weight), 1))
        pairs, first = np.unique(seen, return_index=True)
        held = np.add.reduceat(self.weight[posted], first) if len(first) else np.empty(0)
        pairs = pairs[held >= SHARE * self.total[pairs % len(self.total)]]
        keep = np.isin(pair, pairs)
        pair, posting, begin = pair[keep], posting[keep], at[keep] - self.place[posting[keep]]
        order = np.lexsort((posting, begin, pair))
        pair, posting, begin = pair[order], posting[order], begin[order]
        bounds = np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair))
        for a, b in zip(bounds, bounds[1:]):
            d, t = divmod(int(pair[a]), len(self.total))
            yield from ((d, t, o, s) for o, s in self._windows(posting[a:b], begin[a:b], self.total[t]))

    def _windows(self, posting: np.ndarray, begin: np.ndarray, total: float) -> Iterator[tuple[int, float]]:
        """Beginnings with enough weight within ``SLACK`` words from there, each posting counted once."""
        count: dict[int, int] = {}
        weight, end = 0.0, 0
        posting, begin = posting.tolist(), begin.tolist()
        for k, o in enumerate(begin):
            while end < len(begin) and begin[end] <= o + SLACK:
                count[posting[end]] = count.get(posting[end], 0) + 1
                weight += self.weight[posting[end]] if count[posting[end]] == 1 else 0.0
                end += 1
            if (k == 0 or begin[k - 1] != o) and weight >= SHARE * total - 1e-9:
                yield o, min(1.0, weight / total)
            count[posting[k]] -= 1
            weight -= 0.0 if count[posting[k]] else self.weight[posting[k]]

    def matches(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """``document, beginning, template, share`` of verified places, counted from the document's first word."""
        held: list[tuple[int, int, int, float]] = []
        for d, t, o, share in [*self.proposals(codes, starts), (-1, -1, 0, 0.0)]:
            if held and (held[0][:2] != (d, t) or o >= held[0][2] + len(self.known.texts[t])):
                _, _, best, top = max(held, key=lambda x: (round(x[3], 9), -x[2]))
                yield held[0][0], max(best - int(starts[held[0][0]]), 0), held[0][1], top
                held = []
            if d >= 0:
                low = max(o - SLACK, int(starts[d]))
                place = codes[low:min(o + len(self.known.texts[t]) + 2 * SLACK, int(starts[d + 1]))]
                if all(len(stands(place, p)) for p in self.known.needs[t]):
                    held.append((d, t, o, share))


def word_frequencies(docs: DataFrame, text: str, known: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many texts each known word occurs, and how many texts there are; summed in tasks, then over tasks."""
    n = len(known.number)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            for part in binary_rows([batch], "raw", BATCH_BYTES):
                codes, starts = known.read(t.as_py() for t in part.column("raw"))
                at = np.flatnonzero(codes >= 0)
                seen = np.unique((np.searchsorted(starts, at, side="right") - 1) * n + codes[at])
                total[:n] += np.bincount(seen % n, minlength=n)
                total[n] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(total)], names=["word", "texts"])

    rows = docs.select(F.col(f"`{text}`").cast("binary").alias("raw")).mapInArrow(run, "word long, texts long")
    found = rows.groupBy("word").agg(F.sum("texts").alias("texts")).collect()  # one row per word of the templates
    out = np.zeros(n + 1, np.int64)
    for r in found:
        out[r["word"]] = r["texts"]
    return out[:n], int(out[n])


def scan(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str, Sequence[str]]] = TEMPLATES,
         base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """``doc_id, n_words, base, matches``: base phrases and templates with the words where they begin, in that order."""
    known = Vocabulary(templates, base)
    index = docs.sparkSession.sparkContext.broadcast(Index(known, *word_frequencies(docs, text, known)))

    def lists(rows: list[list[tuple]], kinds: list) -> pa.ListArray:
        flat = [x for r in rows for x in r]
        columns = [pa.array([x[k] for x in flat], t) for k, (_, t) in enumerate(kinds)]
        ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=[n for n, _ in kinds]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            codes, starts = own.known.read(t.as_py() for t in batch.column("raw"))
            phrases, found = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for phrase, (_, label) in zip(own.known.phrases, own.known.base):
                at = stands(codes, phrase)
                for d, i in zip(np.searchsorted(starts, at, side="right") - 1, at):
                    phrases[d].append((int(i - starts[d]), label))
            for d, start, t, share in own.matches(codes, starts):
                found[d].append((start, t, own.known.templates[t][0], share))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(starts) - 1),
                 lists([sorted(p) for p in phrases], [("start", pa.int64()), ("label", pa.string())]),
                 lists([sorted(p) for p in found], [("start", pa.int64()), ("template", pa.int32()), ("label", pa.string()), ("score", pa.float64())])],
                names=["doc_id", "n_words", "base", "matches"])

    return docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias("raw")).mapInArrow(run, SCHEMA)
