import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def checkpoint(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """NULLs in every column, empty, short and long texts, repeated rows and ids, and columns named like working ones."""
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(60, 200)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 5) for i in range(60)]
    rows += [(60, None, "en", "a", None), (61, "", "en", "a", 0), (62, " \n\t ", None, None, 0), (None, words(rng, 80), "en", "a", 1),
             (None, None, None, None, None), (63, words(rng, 30_000, 5000), "en", "b", 1), (64, rows[3][1], "en", "a", 1),
             (64, rows[3][1], "en", "a", 1), (65, rows[4][1], "de", "a", 1), (65, words(rng, 90), "de", "a", 1), (66, "one", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(f"{c}!") for c in ("size", "shard", "copies", "doc", "key", "raw", "stratum", "bucket", "n_words", "fp", "place")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(2), int(rng.random() < 0.2)) for i in range(40)] + [(None, 1, 0), (3, None, 1), (3, 0, 0), (4, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
