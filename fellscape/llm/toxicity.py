"""Toxicity by compression distance between two zstandard dictionaries.

*Dictionaries.*  The ordinary dictionary is trained on windows of ordinary texts.  Toxic material is a small part of a toxic text,
and a dictionary trained on whole toxic texts holds mostly the same ordinary words (the README has its figures).  So the toxic
dictionary is trained on the passages of toxic windows that set them apart: stretches covered by byte strings, also across
words, that occur in a significantly larger share of the toxic fitting texts.  Every occurrence is a sample for the trainer, which weighs them
by how often they come.  Both dictionaries end in the same ordinary background, so that the lengths of a window
differ only where toxic material is matched.

*Distance.*  A text is cut into windows of ``WINDOW`` words and each is compressed with both
dictionaries.  The difference of the two lengths is the evidence of the window; the whole
text is covered, whatever its length.

*Calibration.*  Half of the fitting texts train the dictionaries.  On the other half a logistic
curve over the largest difference, their sum and the number of windows gives a probability.

Fitting takes a bounded sample: at most ``Fit.toxic`` and ``Fit.ordinary`` labelled texts, of at
most ``Fit.max_bytes`` each, those with the smallest hashes of their ids.  Scoring takes every row.

NULL and empty texts have no windows and get the score of no evidence.  Texts are scored whole, however long.  Repeated rows get a row each; a text labelled
several times is toxic if any label says so.  An empty table gives an empty result.  Of ``docs`` only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from fellscape.llm.common import binary_rows
from fellscape.session import cut

WINDOW = 12
GRAM = 5
BATCH_BYTES = 8 << 20
EVIDENCE = 2  # bytes saved from which a window counts


@dataclass(frozen=True)
class Fit:
    """Bounds of the fitting sample and sizes of the dictionaries."""

    toxic: int = 1500
    ordinary: int = 4500
    max_bytes: int = 32 << 10
    background_bytes: int = 110_000
    toxic_bytes: int = 48_000
    significance: float = 5.0
    min_texts: int = 4
    min_ratio: float = 5.0


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def windows(words: Sequence[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i:i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def grams(words: Sequence[bytes]) -> set[bytes]:
    return {w[i:i + GRAM] for w in windows(words) for i in range(len(w) - GRAM + 1)}


def telling_grams(toxic: Sequence[list[bytes]], ordinary: Sequence[list[bytes]], fit: Fit) -> set[bytes]:
    """Byte strings typical of toxic texts."""
    ours, theirs = Counter(), Counter()
    for words in toxic:
        ours.update(grams(words))
    candidates = {g for g, n in ours.items() if n >= fit.min_texts}
    for words in ordinary:
        theirs.update(grams(words) & candidates)
    n, m = len(toxic), len(ordinary)

    def significance(g: bytes) -> float:
        p, q, both = ours[g] / n, theirs[g] / m, (ours[g] + theirs[g]) / (n + m)
        return (p - q) / math.sqrt(both * (1 - both) * (1 / n + 1 / m) + 1e-12)

    return {g for g in candidates if significance(g) >= fit.significance and ours[g] / n >= fit.min_ratio * (theirs[g] + 0.5) / m}


def passages(window: bytes, telling: set[bytes]) -> list[bytes]:
    """Maximal stretches of a window that overlapping or touching telling strings cover."""
    out, start, end = [], 0, -1
    for i in range(len(window) - GRAM + 1):
        if window[i:i + GRAM] in telling:
            if i > end:
                if end > 0:
                    out.append(window[start:end])
                start = i
            end = i + GRAM
    return [*out, window[start:end]] if end > 0 else out


def dictionary(size: int, samples: Sequence[bytes], k: int) -> bytes:
    """Content that the trainer of zstandard makes of samples; with too little to train on, the distinct samples, frequent ones last."""
    try:
        return zstandard.train_dictionary(size, list(samples), k=k, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        count = Counter(samples)
        return b"".join(sorted(count, key=lambda x: (count[x], x)))[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] | None
    rate: float

    def compressors(self):
        made = []
        for content in (self.ordinary, self.toxic):
            p = zstandard.ZstdCompressionParameters.from_level(
                3, strategy=zstandard.STRATEGY_BTLAZY2, min_match=5, window_log=17,
                write_content_size=0, write_checksum=0, write_dict_id=0)
            d = zstandard.ZstdCompressionDict(content, zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        return made

    def features(self, texts: Sequence[bytes | None], compressors) -> np.ndarray:
        """Largest saving, logarithm of the summed savings and of the number of windows, of each text."""
        cut = [windows(words_of(t)) for t in texts]
        counts = np.array([len(c) for c in cut])
        flat = [w for c in cut for w in c]
        out = np.zeros((len(texts), 3))
        if flat:
            sizes = []
            for c in compressors:
                packed = c.multi_compress_to_buffer(flat)
                sizes.append(np.fromiter((len(packed[i]) for i in range(len(packed))), np.int64, len(packed)))
            saved = sizes[0] - sizes[1]
            owner = np.repeat(np.arange(len(texts)), counts)
            np.maximum.at(out[:, 0], owner, np.clip(saved, 0, 12))
            out[:, 1] = np.log1p(np.bincount(owner, np.where(saved >= EVIDENCE, saved, 0), len(texts)))
        out[:, 2] = np.log1p(counts)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.rate)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(features @ w[1:] + w[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    a = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    keep[0, 0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + keep, a.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def train(sample: Sequence[tuple[bytes, int]], fit: Fit = Fit()) -> Model:
    """A model from labelled texts; with under two texts of a class for either half every score is the base rate."""
    half = {(side, label): [t for t, x in sample if x == label and zlib.crc32(t) % 2 == side] for side in (0, 1) for label in (0, 1)}
    rate = sum(x for _, x in sample) / len(sample) if sample else 0.0
    if min(map(len, half.values())) < 2:
        return Model(b"", b"", None, rate)
    toxic, ordinary = ([words_of(t) for t in half[0, label]] for label in (1, 0))
    base = dictionary(fit.background_bytes, [w for words in ordinary for w in windows(words)], 64)
    telling = telling_grams(toxic, ordinary, fit)
    own = dictionary(fit.toxic_bytes, [x for words in toxic for w in windows(words) for x in passages(w, telling)], 32)
    model = Model(base, own + base, None, rate)
    texts = [*half[1, 1], *half[1, 0]]
    y = np.array([1.0] * len(half[1, 1]) + [0.0] * len(half[1, 0]))
    model.weights = logistic(model.features(texts, model.compressors()), y)
    return model


def training_row(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def sample(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> list[tuple[bytes, int]]:
    """The bounded fitting sample; a text labelled several times is toxic if any label says so.

    Ids are chosen first, from ids and sizes alone.  There are at most ``fit.toxic + fit.ordinary`` of them,
    so that they are broadcast to fetch their texts, and no text is shuffled.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & training_row(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    fits = F.octet_length("text").between(1, fit.max_bytes)
    bounds = ((1, fit.toxic), (0, fit.ordinary))
    labelled = docs.where(fits).select("doc_id").join(known, "doc_id").withColumn("at", F.md5(F.col("doc_id").cast("string")))
    labelled = cut(labelled.distinct())
    first = [labelled.where(F.col("toxic") == label).orderBy("at").limit(bound) for label, bound in bounds]
    chosen = cut(first[0].unionAll(first[1]))
    rows = docs.where(fits).select("doc_id", F.col("text").cast("binary").alias("raw")).join(F.broadcast(chosen), "doc_id")
    out = []
    for label, bound in bounds:  # rows that repeat an id do not widen the bound
        own = rows.where(F.col("toxic") == label).orderBy("at", "raw").limit(bound).select("raw", "toxic")
        out += [(bytes(r["raw"]), r["toxic"]) for r in own.toLocalIterator()]
    return out


def score(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row per row of ``docs``.

    Only the text enters a score.  NULL and empty texts have no windows and get the score of no
    evidence.  A NULL ``doc_id`` is not held out (false).
    """
    model = train(sample(docs, labels, fit), fit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model.weights is not None else []
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            texts = batch.column("raw").to_pylist()
            scores = model.scores(model.features(texts, compressors) if compressors else np.zeros((len(texts), 3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores)], names=["doc_id", "held_out", "score"])

    held = F.coalesce(~training_row(F.col("doc_id")), F.lit(False))
    source = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("raw"))
    return (source.mapInArrow(run, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
