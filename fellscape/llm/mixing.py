"""Mixing sources to target weights by systematic sampling.

Sources share ``budget`` times the words of all documents by weight.  A target stops at ``cap`` times
its source's words; the excess is shared again by weight among the others.  Ordered by cap per weight the
capped sources come first, so that two running sums find the common level.

Within a source every document is expected ``target / size of the source`` times.  These expectations are
summed up along an order of the documents, one random offset per source is added, and a document is
emitted once per whole number that the running sum crosses.  The order goes by size class, then by hash,
so that each class is sampled evenly and the words taken stay close to the target.

The running sum is the expectation times the position, and positions come from counted buckets: a
source of any size is numbered by many tasks.  Everything is DataFrame functions.

NULL and empty texts have size 0 and are emitted like others of their class; a NULL source is one of its own, ordered last.  Texts are taken whole.  Equal
hashes are told apart by position, and repeated rows count as rows.  An empty table gives an empty result.  ``mixed`` carries the columns of ``docs``
inside one struct, so that their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fellscape.functions.columns import key_hash
from fellscape.llm.common import broadcast_if_small, word_count
from fellscape.operators.position import hex_bucket, hex_digits
from fellscape.session import cut


@dataclass(frozen=True)
class Mix:
    weights: Sequence[float] = (3, 1, 2)
    budget: float = 1.5
    cap: float = 2.0
    seed: int = 11


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``source, source_size, n, target`` from ``source, source_size, n``; one row per source, NULL last.

    Weights follow the order of the names by code point and repeat.
    """
    order = F.col("source").asc_nulls_last()
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order))
    s = (sources.withColumn("rank", rank).withColumn("w", F.element_at(weights, ((F.col("rank") - 1) % len(mix.weights) + 1).cast("int")))
         .withColumn("cap", mix.cap * F.col("source_size")))
    by_cap = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "rank")
    total = F.sum("source_size").over(W.partitionBy(F.lit(0)))
    capped_before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (mix.budget * total - capped_before) / weight_left)
    s = s.withColumn("capped", F.min((F.col("cap") <= F.col("w") * F.col("level")).cast("int")).over(by_cap) == 1)
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(W.partitionBy(F.lit(0)))
    return s.select("source", "source_size", "n", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def size_class(size: Column) -> Column:
    """Grows with the size; eight classes between powers of two."""
    digits = F.bin(size)
    return F.length(digits) * 8 + F.conv(F.substring(F.concat(digits, F.lit("000")), 2, 3), 2, 10).cast("int")


def numbered(docs: DataFrame, mix: Mix, kept: Sequence[str]) -> DataFrame:
    """``doc`` (a struct of the columns ``kept``), ``source, size, class`` and ``key`` of every row."""
    size = word_count(F.col("text"))
    key = key_hash("mix", mix.seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col("source"), size.alias("size"),
                       key.alias("key")).withColumn("class", size_class(F.col("size")))


def with_copies(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Rows of :func:`numbered` with ``source_size, target`` and ``copies``; the same on every run.

    NULL texts have no words.  Rows that agree in id and text are interchangeable.  A NULL source is a
    source of its own, the last.  Nothing is taken from a source without words.
    """
    thin = rows.select("source", "size", "class", F.substring("key", 1, 7).alias("lead"))
    totals = cut(targets(thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), mix))
    digits = hex_digits(totals.agg(F.sum("n")).first()[0] or 0)
    before = W.partitionBy("source").orderBy("class", "bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = (thin.groupBy("source", "class", hex_bucket(F.col("lead"), digits).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
              .withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(key_hash("start", mix.seed, F.coalesce("known", F.lit(""))), 1, 4), 16, 10).cast("double") / 65536.0
    totals = totals.select(F.col("source").alias("known"), "source_size", "target", rate.alias("rate"), start.alias("start"))
    places = cut(counts.join(totals, F.col("source").eqNullSafe(F.col("known")))
                 .select("known", F.col("class").alias("its_class"), F.col("bucket").alias("its_bucket"), "offset",
                         "source_size", "target", "rate", "start"))
    met = (rows.withColumn("bucket", hex_bucket(F.col("key"), digits))
           .join(broadcast_if_small(places), F.col("source").eqNullSafe(F.col("known")) & (F.col("class") == F.col("its_class"))
                 & (F.col("bucket") == F.col("its_bucket"))))
    place = F.row_number().over(W.partitionBy("source", "class", "bucket").orderBy("key")) + F.col("offset")
    met = met.withColumn("place", place.cast("double"))
    crossed = F.floor(F.expr("start + rate * place")) - F.floor(F.expr("start + rate * (place - 1)"))
    return met.select("doc", "source", "size", "source_size", "target", F.least(crossed, F.ceil("rate")).cast("long").alias("copies"))


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (words with repeats), a row per row of ``docs``; texts are read once."""
    rows = cut(numbered(docs, mix, ["doc_id"]))
    return with_copies(rows, mix).select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents themselves, each as often as it is emitted, with the columns of ``docs``."""
    rows = with_copies(numbered(docs, mix, docs.columns), mix).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *[F.col("doc").getField(c).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
         md5('mix:11:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
c AS (SELECT *, 2.0 * source_size::DOUBLE AS cap, 1.5 * (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
m AS (SELECT *, min((cap <= w * level)::INT) OVER (ORDER BY cap / w, rank) = 1 AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * max(CASE WHEN NOT capped THEN level END) OVER () END AS target FROM m),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('start:11:' || coalesce(source, '')), 1, 4))::BIGINT / 65536.0::DOUBLE AS start FROM t),
n AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, r.start,
             row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)) * 8 +
               (CASE substr(bin(d.size) || '000', 2, 1) WHEN '1' THEN 4 ELSE 0 END) + (CASE substr(bin(d.size) || '000', 3, 1) WHEN '1' THEN 2 ELSE 0 END)
               + (CASE substr(bin(d.size) || '000', 4, 1) WHEN '1' THEN 1 ELSE 0 END), d.key)::DOUBLE AS place
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       least(floor(start + rate * place) - floor(start + rate * (place - 1)), ceil(rate))::BIGINT * size AS taken FROM n
"""
