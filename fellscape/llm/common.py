"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are maximal runs without space, tab, newline, vertical tab, form feed and carriage return,
#: which is also what ``bytes.split()`` cuts at.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a table that may be broadcast after they were counted.
SMALL_ROWS = 50_000

#: Bytes of rows that Spark packs into one Arrow batch for Python.
ARROW_LIMIT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with no column of ``df``, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL (long)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a *written* table after counting it; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_batches(rows: DataFrame) -> DataFrame:
    """``rows``, whole, for a function over Arrow batches: a batch ends at about ``ARROW_BYTES``, or at the limit that the session names.

    Spark's default limits let all texts of a split meet in one batch.  Its buffers double as they grow, outside the heap, and Python holds
    the batch once more.  The limit stays in the session, since rows are read when the caller's plan runs; no result depends on it.
    """
    if rows.sparkSession.conf.get(ARROW_LIMIT, None) is None:
        rows.sparkSession.conf.set(ARROW_LIMIT, str(ARROW_BYTES))
    return rows


def binary_rows(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` in each; no row is dropped."""
    for batch in batches:
        start, size = 0, 0
        lengths = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        for i, n in enumerate(lengths):
            if i > start and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
