"""Sample tables of the registered queries, in Spark and in SQL over the same parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fellscape.functions.columns import GRID
from fellscape.operators.clean import dedup_keep_first
from fellscape.operators.rescale import Bounds, rescale_affine

PART_BOUNDS = Bounds(("x1", "x2"), (1.0, 900.0), (50.0, 1000.0))
LINE_BOUNDS = Bounds(("x1", "x2", "x3"), (1.0, 0.0, 0.0), (50.0, 0.1, 0.08))
RESPONSES = ["y1", "y2"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _mean(c: str):
    """Mean of a column of cents or percents, summed in whole numbers: the same in any order of rows."""
    return F.avg(F.round(F.col(c) * 100)) / 100


def doe_part(spark: SparkSession, sf: str) -> DataFrame:
    """One sample per part: size and price as inputs, its sales as responses.

    The line items are summed by part before the join, so the join moves one row per part.
    """
    sales = (table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("sample_id"))
             .agg(_mean("l_extendedprice").alias("y1"), F.sum("l_quantity").alias("y2")))
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("sample_id"), F.col("p_size").cast("double").alias("x1"),
        F.col("p_retailprice").alias("x2"))
    return part.join(sales, "sample_id", "left")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Complete, unique and rescaled samples of :func:`doe_part`."""
    whole = doe_part(spark, sf).dropna("any", subset=["x1", "x2", "y1", "y2"])
    unique = dedup_keep_first(whole, ["x1", "x2"], "sample_id")
    return rescale_affine(unique, PART_BOUNDS, Bounds.cube(["x1", "x2"]))


def part_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Rescaled inputs of every part, without responses."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("sample_id"), F.col("p_size").cast("double").alias("x1"),
        F.col("p_retailprice").alias("x2"))
    return rescale_affine(part, PART_BOUNDS, Bounds.cube(["x1", "x2"]))


def doe_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """One sample per line item; six columns together identify it."""
    line = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(price * 100).cast("bigint").cast("string"),
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("sample_id"),
        F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"),
        price.alias("y1"), (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y2"))


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A wide feature table: one row per label, built from the sales of a brand and type."""
    joined = (table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
              .join(table(spark, sf, "lineitem").select(
                  F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
                  "p_partkey"))
    groups = joined.groupBy("p_brand", "p_type").agg(
        F.avg("l_quantity").alias("q_mean"), F.stddev_pop("l_quantity").alias("q_sd"),
        _mean("l_extendedprice").alias("price_mean"), F.stddev_pop("l_extendedprice").alias("price_sd"),
        _mean("l_discount").alias("disc_mean"), F.stddev_pop("l_discount").alias("disc_sd"),
        _mean("l_tax").alias("tax_mean"), F.stddev_pop("l_tax").alias("tax_sd"))
    n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    k = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("p_type")).cast("int")
    label = (F.when(n <= 20, F.format_string("bbob_f%d_ins%d", n, k))
             .when(n <= 22, F.concat(F.lit("problem_"), n.cast("string")))
             .otherwise(F.format_string("rgf%d", n - 22)))
    kind = F.when(n <= 20, "bbob").when(n <= 22, "problem").otherwise("rgf")
    fid = F.when(n <= 20, n)
    iid = F.when(n <= 20, k)
    inf = F.lit(float("inf"))
    return groups.select(
        label.alias("label"), kind.alias("kind"), fid.alias("fid"), iid.alias("iid"), k.alias("rep"),
        "q_mean", "q_sd", "price_mean", "price_sd", "disc_mean", "disc_sd", "tax_mean", "tax_sd",
        (F.col("q_mean") * 3.0).alias("q_triple"), F.lit(7.0).alias("always"),
        F.when(n != 24, F.col("q_sd") / F.col("q_mean")).alias("q_var"),
        F.when(n == 25, inf).otherwise(F.col("tax_mean")).alias("tax_open"),
        F.when((n == 3) & (k == 2), None).otherwise(F.col("disc_mean")).alias("disc_gap"),
        F.lit(None).cast("double").alias("nothing"),
        (F.col("price_mean") / 1000).alias("pca.expl_var.cov_x"),
        (F.col("price_sd") / 1000).alias("ela_meta.costs_runtime"))


FEATURES = ["q_mean", "q_sd", "price_mean", "price_sd", "disc_mean", "disc_sd", "tax_mean", "tax_sd", "q_triple",
            "always", "q_var", "tax_open", "disc_gap", "nothing", "pca.expl_var.cov_x", "ela_meta.costs_runtime"]

DOE_PART = """doe AS (SELECT p_partkey AS sample_id, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2,
  avg(round(l_extendedprice * 100)) / 100 AS y1, sum(l_quantity) AS y2
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"""
POINTS = DOE_PART + """,
uniq AS (SELECT * FROM doe WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY x1, x2 ORDER BY sample_id) = 1),
pts AS (SELECT sample_id, (x1 - 1.0::DOUBLE) / 49.0::DOUBLE * 10.0::DOUBLE - 5.0::DOUBLE AS x1,
  (x2 - 900.0::DOUBLE) / 100.0::DOUBLE * 10.0::DOUBLE - 5.0::DOUBLE AS x2, y1, y2 FROM uniq),
lim AS (SELECT min(y1) AS lo1, max(y1) AS hi1, min(y2) AS lo2, max(y2) AS hi2 FROM pts),
norm AS (SELECT sample_id, x1, x2, (y1 - lo1) / (hi1 - lo1) AS y1, (y2 - lo2) / (hi2 - lo2) AS y2 FROM pts, lim),
samples AS (SELECT 'y1' AS label, sample_id, x1, x2, y1 AS y FROM norm
  UNION ALL SELECT 'y2', sample_id, x1, x2, y2 FROM norm)"""
PART_INPUTS = """pts AS (SELECT p_partkey AS sample_id,
  (CAST(p_size AS DOUBLE) - 1.0::DOUBLE) / 49.0::DOUBLE * 10.0::DOUBLE - 5.0::DOUBLE AS x1,
  (p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE * 10.0::DOUBLE - 5.0::DOUBLE AS x2 FROM part)"""
DOE_LINEITEM = """line AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS sample_id,
  l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice AS y1,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y2 FROM lineitem)"""
FEATURE_ROWS = """grp AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS n, p_type,
  avg(l_quantity) AS q_mean, stddev_pop(l_quantity) AS q_sd,
  avg(round(l_extendedprice * 100)) / 100 AS price_mean, stddev_pop(l_extendedprice) AS price_sd,
  avg(round(l_discount * 100)) / 100 AS disc_mean, stddev_pop(l_discount) AS disc_sd, avg(round(l_tax * 100)) / 100 AS tax_mean, stddev_pop(l_tax) AS tax_sd
  FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand, p_type),
num AS (SELECT *, CAST(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) AS INTEGER) AS k FROM grp),
feat AS (SELECT CASE WHEN n <= 20 THEN concat('bbob_f', n, '_ins', k) WHEN n <= 22 THEN concat('problem_', n)
    ELSE concat('rgf', n - 22) END AS label,
  CASE WHEN n <= 20 THEN 'bbob' WHEN n <= 22 THEN 'problem' ELSE 'rgf' END AS kind,
  CASE WHEN n <= 20 THEN n END AS fid, CASE WHEN n <= 20 THEN k END AS iid, k AS rep,
  q_mean, q_sd, price_mean, price_sd, disc_mean, disc_sd, tax_mean, tax_sd,
  q_mean * 3.0::DOUBLE AS q_triple, 7.0::DOUBLE AS always,
  CASE WHEN n <> 24 THEN q_sd / q_mean END AS q_var,
  CASE WHEN n = 25 THEN 'inf'::DOUBLE ELSE tax_mean END AS tax_open,
  CASE WHEN n = 3 AND k = 2 THEN NULL ELSE disc_mean END AS disc_gap,
  NULL::DOUBLE AS nothing, price_mean / 1000 AS "pca.expl_var.cov_x", price_sd / 1000 AS "ela_meta.costs_runtime"
  FROM num)"""
SENTINEL = """raw AS (SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderstatus = 'P' THEN 'EXPRESSION_ERROR' ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders)"""


def sentinel(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose price is kept as text, with the sentinel where the order is pending."""
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") == "P", "EXPRESSION_ERROR")
        .otherwise(F.col("o_totalprice").cast("string")).alias("price"))


def t(expr: str, digits: int = 6) -> str:
    """SQL counterpart of ``tidy``."""
    grid = f"{GRID[digits]}.0::DOUBLE"
    return f"(round_even(({expr}) * {grid}, 0) / {grid} + 0.0)"


def f(expr: str) -> str:
    """SQL counterpart of ``single``."""
    return f"(CAST(CAST({expr} AS FLOAT) AS DOUBLE) + 0.0)"


def r(cols, digits: int = 6) -> str:
    return ", ".join(f'{t(quoted(c), digits)} AS "{c}"' for c in cols)


def s(cols) -> str:
    return ", ".join(f'{f(quoted(c))} AS "{c}"' for c in cols)


def quoted(name: str) -> str:
    return f'"{name}"'
