"""Texts reach Python in Arrow batches of bounded bytes, however many and long the rows of a split are."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fellscape.llm import decontaminate, quality, similar
from fellscape.llm.common import ARROW_BYTES, ARROW_LIMIT

STEPS = {
    quality: lambda docs: quality.with_measures(docs)[0],
    similar: lambda docs: similar._mapped(similar._keyed(docs, "text"), "n long", [pa.int64()], lambda x: (len(x),)),
    decontaminate: lambda docs: decontaminate.document_windows(docs, np.full(1 << 13, 255, np.uint8), [8]).select("doc_id").distinct(),
}


@pytest.fixture
def unlimited(spark):
    """A session without a limit of its own; what it had comes back."""
    before = spark.conf.get(ARROW_LIMIT, None)
    spark.conf.unset(ARROW_LIMIT)
    yield spark
    spark.conf.unset(ARROW_LIMIT) if before is None else spark.conf.set(ARROW_LIMIT, before)


def long_texts(spark):
    """18 MB in one split."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda k: F.concat(F.lit("word"), F.col("id") * 7 + k)), " ")
    return spark.range(0, 64, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))


@pytest.mark.parametrize("module", STEPS, ids=lambda m: m.__name__.rpartition(".")[2])
def test_batches_are_bounded(unlimited, monkeypatch, module):
    cut = module.binary_rows

    def bounded(batches, column, max_bytes):
        for batch in batches:
            assert batch.nbytes <= 3 * ARROW_BYTES, batch.nbytes
            yield from cut([batch], column, max_bytes)

    monkeypatch.setattr(module, "binary_rows", bounded)
    assert {r["doc_id"] for r in STEPS[module](long_texts(unlimited)).select("doc_id").collect()} == set(range(64))


def test_a_limit_of_the_session_stays(unlimited):
    unlimited.conf.set(ARROW_LIMIT, "1m")
    quality.with_measures(long_texts(unlimited))
    assert unlimited.conf.get(ARROW_LIMIT) == "1m"
