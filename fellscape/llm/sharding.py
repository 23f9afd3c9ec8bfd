"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

1. Rows are dealt to logical partitions by hash.  Which rows a partition sends where depends on
   data alone, so a retried task repeats its work exactly.
2. The matrix of rows that partition ``p`` sends to shard ``s`` is drawn exactly: its margins are the counted
   partitions and the shard sizes, which differ by one row at most.  Partitions are halved as a tree;
   at each node the shards' rows are split between the halves by successive hypergeometric
   draws, and the halves are independent given that split.  A draw sums the probabilities relative to
   each other over ten standard deviations, so no factorial is needed.
3. Each partition permutes its rows locally and deals them by its row of the matrix (first exchange).
4. Each shard permutes what arrived: rows go to parts of the shard by a new hash, parts are counted,
   and rows are numbered inside their part (second exchange).

Everything is DataFrame functions; no partition, shard or matrix passes through one task whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fellscape.llm.common import broadcast_if_small
from fellscape.session import cut

MAX_LEVELS = 16


@dataclass(frozen=True)
class Layout:
    shards: int = 40
    seed: int = 23
    rows_per_partition: int = 50_000
    min_levels: int = 6


def lead(h: str, bits: int) -> Column:
    """The leading bits of a long hash, as a number from 0."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def draw(k: str, r: str, m: str, u: str) -> str:
    """SQL of one hypergeometric draw: ``m`` rows are taken from ``r``, of which ``k`` are marked; how many marked?

    ``u`` is uniform in [0, 1).  Weights start at 1 at the low end and follow the ratio of neighbouring
    probabilities; the end lies ten deviations below the mean or at the support's end.
    """
    return f"""
      element_at(transform(array(named_struct('k', {k}, 'r', {r}, 'm', {m}, 'u', {u})), a ->
       element_at(transform(array(named_struct(
          'mean', IF(a.r > 0, a.k * 1D * a.m / a.r, 0D),
          'dev', IF(a.r > 1, sqrt(a.m * 1D * a.k / a.r * (a.r - a.k) / a.r * (a.r - a.m) / (a.r - 1)), 0D))), b ->
        element_at(transform(array(named_struct(
           'lo', greatest(0L, a.m - (a.r - a.k), CAST(floor(b.mean - 10 * b.dev - 10) AS BIGINT)),
           'hi', least(a.k, a.m, CAST(ceil(b.mean + 10 * b.dev + 10) AS BIGINT)))), c ->
         element_at(transform(array(aggregate(sequence(c.lo, c.hi), named_struct('w', 1D, 'sum', 0D),
             (s, x) -> named_struct('w', s.w * (a.k - x) * (a.m - x) / ((x + 1D) * (a.r - a.k - a.m + x + 1D)), 'sum', s.sum + s.w),
             s -> s.sum)), total ->
          aggregate(sequence(c.lo, c.hi), named_struct('w', 1D, 'left', a.u * total, 'x', c.lo, 'found', false),
             (s, x) -> named_struct('w', s.w * (a.k - x) * (a.m - x) / ((x + 1D) * (a.r - a.k - a.m + x + 1D)),
                                    'left', s.left - s.w, 'x', IF(s.found, s.x, x), 'found', s.found OR s.left < s.w),
             s -> s.x)), 1)), 1)), 1)), 1)"""


def halved(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """``node, counts, margin`` of the next level: both halves of every node."""
    half = "slice(counts, 1, CAST(size(counts) / 2 AS INT))"
    uniform = f"(shiftrightunsigned(xxhash64({seed}, {level}, node, i), 11) / 9007199254740992D)"
    left = nodes.withColumn("low", F.expr(half)).withColumn("high", F.expr("slice(counts, CAST(size(counts) / 2 AS INT) + 1, size(counts))")).withColumn(
        "left", F.expr(f"""
          aggregate(sequence(0, size(margin) - 1),
            named_struct('k', aggregate(low, 0L, (s, x) -> s + x), 'r', aggregate(counts, 0L, (s, x) -> s + x), 'out', CAST(array() AS ARRAY<BIGINT>)),
            (st, i) -> element_at(transform(array({draw('st.k', 'st.r', 'margin[i]', uniform)}),
                x -> named_struct('k', st.k - x, 'r', st.r - margin[i], 'out', concat(st.out, array(x)))), 1),
            st -> st.out)"""))
    return left.select(F.explode(F.expr("""array(
        named_struct('node', node * 2, 'counts', low, 'margin', left),
        named_struct('node', node * 2 + 1, 'counts', high, 'margin', zip_with(margin, left, (m, x) -> m - x)))""")).alias("n")).select("n.*")


def matrix(counts: DataFrame, total: int, levels: int, layout: Layout) -> DataFrame:
    """``node, margin``: for each of ``2**levels`` partitions the rows it sends to each shard."""
    base, more = divmod(total, layout.shards)
    sizes = F.transform(F.sequence(F.lit(0), F.lit(layout.shards - 1)), lambda s: (F.lit(base) + F.when(s < more, 1).otherwise(0)).cast("long"))
    spark = counts.sparkSession
    filled = spark.range(1 << levels).select(F.col("id").alias("p")).join(counts, "p", "left").select("p", F.coalesce("c", F.lit(0)).alias("c"))
    nodes = (filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda x: x["c"]).alias("counts"))
             .select(F.lit(0).cast("long").alias("node"), "counts", sizes.alias("margin")))
    for level in range(levels):
        if level and level % 4 == 0:
            nodes = cut(nodes).repartition(1 << min(level, 10), "node")
        nodes = halved(nodes, level, layout.seed)
    return nodes.select("node", "margin")


def keyed(docs: DataFrame, layout: Layout, kept: list[str]) -> DataFrame:
    """``doc`` (a struct of the columns ``kept``), ``size`` in bytes, ``text_crc32`` and the hash ``h`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.col("doc_id").alias("id")).withColumn(
        "h", F.xxhash64(F.lit(layout.seed), "id", "size", "text_crc32"))


def dealt(rows: DataFrame, sends: DataFrame, levels: int, layout: Layout) -> DataFrame:
    """Rows with their ``shard`` and a hash ``again`` for the second permutation.

    Rows alike in id, size and checksum are numbered first, so that copies part ways like other rows.
    """
    rows = rows.withColumn("p", lead("h", levels)).repartition("p")
    rows = rows.withColumn("copy", F.row_number().over(W.partitionBy("p", "h", "id", "size", "text_crc32").orderBy("h")))
    rows = rows.withColumn("key", F.xxhash64(F.lit(layout.seed + 1), "h", "copy"))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("p").orderBy("key", "h", "id", "size", "text_crc32", "copy")) - 1)
    bounds = sends.select("node", F.expr("transform(sequence(1, size(margin)), i -> aggregate(slice(margin, 1, i), 0L, (s, x) -> s + x))").alias("bounds"))
    met = rows.join(bounds, rows["p"] == bounds["node"])
    shard = F.size(F.filter("bounds", lambda b: b <= F.col("place")))
    return (met.withColumn("shard", shard).withColumn("again", F.xxhash64(F.lit(layout.seed + 2), "p", "place"))
            .select("doc", "size", "text_crc32", "shard", "again", "p", "place"))


def sharded(rows: DataFrame, layout: Layout = Layout(), thin: DataFrame | None = None) -> DataFrame:
    """Rows of :func:`keyed` with ``shard`` and ``slot``, numbered from 0 without gaps in each shard.

    ``thin`` may give the same rows without their documents, to count and draw from; the rows
    themselves are then exchanged twice and read once more.  An empty table gives an empty result.
    """
    thin = rows if thin is None else thin
    fine = cut(thin.groupBy(lead("h", MAX_LEVELS).alias("p")).agg(F.count(F.lit(1)).alias("c")))
    total = fine.agg(F.sum("c")).first()[0] or 0
    levels = min(MAX_LEVELS, max(layout.min_levels, math.ceil(math.log2(max(1, total / layout.rows_per_partition)))))
    coarse = fine.groupBy(F.shiftright("p", MAX_LEVELS - levels).cast("long").alias("p")).agg(F.sum("c").alias("c"))
    sends = broadcast_if_small(cut(matrix(coarse, total, levels, layout)))
    if thin is rows:
        rows = thin = cut(dealt(rows, sends, levels, layout))
    else:
        rows, thin = dealt(rows, sends, levels, layout), dealt(thin, sends, levels, layout)
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = (thin.groupBy("shard", lead("again", levels).alias("part")).agg(F.count(F.lit(1)).alias("c"))
             .select(F.col("shard").alias("its_shard"), F.col("part").alias("its_part"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset")))
    parts = cut(parts)
    rows = rows.withColumn("part", lead("again", levels))
    met = rows.join(broadcast_if_small(parts), (rows["shard"] == parts["its_shard"]) & (rows["part"] == parts["its_part"]))
    slot = F.row_number().over(W.partitionBy("shard", "part").orderBy("again", "p", "place")) + F.col("offset") - 1
    return met.select("doc", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shards(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, a row per row of ``docs``; texts are read once.

    NULL texts count as empty; NULL and repeated ids are rows like others.
    """
    return sharded(cut(keyed(docs, layout, ["doc_id"])), layout).select(
        "doc.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shuffled(docs: DataFrame, layout: Layout = Layout(), shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The documents themselves with their shard and slot; columns of those names are replaced."""
    thin = cut(keyed(docs, layout, []).drop("doc").withColumn("doc", F.lit(None).cast("int")))
    out = sharded(keyed(docs, layout, docs.columns), layout, thin)
    own = [c for c in docs.columns if c.lower() not in (shard.lower(), slot.lower())]
    return out.select(*[F.col("doc").getField(c).alias(c) for c in own], F.col("shard").alias(shard), F.col("slot").alias(slot))
