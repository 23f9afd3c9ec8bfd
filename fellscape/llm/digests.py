"""Digest columns that registered queries derive from the outputs of their operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fellscape.llm.common import binary_rows

BATCH_BYTES = 8 << 20


def turned(text: bytes | None, doc_id: int | None) -> bytes | None:
    """A tenth of the documents, by checksum of the id, repeat a passage from a word on to their end; ids of NULL do not."""
    words = (text or b"").split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of documents, some of which were given a periodic end."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in binary_rows(batches, "raw", BATCH_BYTES):
            texts = [turned(t.as_py(), i.as_py()) for i, t in zip(batch.column("doc_id"), batch.column("raw"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, text string")


def of_runs(marked: DataFrame) -> DataFrame:
    """Count, longest run and checksums of the runs and of what is left."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = marked.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_words", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
                       (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")


def of_licenses(scanned: DataFrame, base_score: float) -> DataFrame:
    """Counts, first and last place, labels and score of a licence scan."""
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    both = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("matches.label"))))
    phrase = F.when(F.size("base") > 0, base_score).otherwise(0.0)
    return scanned.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base.start")).alias("first_word"),
                          F.array_max(F.col("base.start")).alias("last_word"), F.array_join(base, ",").alias("base_labels"),
                          F.array_join(both, ",").alias("labels"),
                          F.greatest(phrase, F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0))).alias("score"))
