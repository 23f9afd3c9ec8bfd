"""Tables of sampled inputs and responses, with the two small tables that describe them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fellscape.functions.columns import col
from fellscape.operators import clean
from fellscape.operators.rescale import Bounds

COLSPEC = T.StructType([
    T.StructField("role", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("new_name", T.StringType()), T.StructField("ord", T.IntegerType())])
BOUNDS = T.StructType([
    T.StructField("dv", T.StringType()), T.StructField("ord", T.IntegerType()),
    T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])


@dataclass(frozen=True)
class ColumnSpec:
    """Listed inputs and outputs with their new names, in order."""

    inputs: tuple[tuple[str, str], ...]
    outputs: tuple[tuple[str, str], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.inputs + self.outputs]

    @property
    def x(self) -> list[str]:
        return [n for _, n in self.inputs]

    @property
    def y(self) -> list[str]:
        return [n for _, n in self.outputs]


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Parquet, CSV (with header) or JSON; text formats need a schema, nothing is inferred."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError(f"{fmt} input needs a schema")
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


def load_colspec(spec: DataFrame) -> ColumnSpec:
    """A study lists tens of columns; the list is read on the driver to build the projection."""
    rows = spec.orderBy("ord").select("role", "name", "new_name").collect()
    pick = lambda role: tuple((r["name"], r["new_name"] or r["name"]) for r in rows if r["role"] == role)
    return ColumnSpec(pick("input"), pick("output"))


def load_bounds(bounds: DataFrame) -> Bounds:
    """Limits in input order, one row per input."""
    rows = bounds.orderBy("ord").select("dv", "lower", "upper").collect()
    return Bounds(tuple(r["dv"] for r in rows), tuple(r["lower"] for r in rows), tuple(r["upper"] for r in rows))


def select_by_spec(df: DataFrame, spec: ColumnSpec, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[col(c) for c in [*keep, *spec.names]])


def rename_by_spec(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    new = dict(spec.inputs + spec.outputs)
    return df.select(*[col(c).alias(new.get(c, c)) for c in df.columns])


def load_doe(df: DataFrame, spec: ColumnSpec, order: str) -> DataFrame:
    """Select, parse, drop incomplete rows, keep the first row per input point, rename.

    Text that is neither a number nor the sentinel is an error, counted before anything is lost.
    """
    picked = select_by_spec(df, spec, keep=[order])
    text = [f.name for f in picked.schema if isinstance(f.dataType, T.StringType) and f.name in spec.names]
    if text:
        bad = [r for r in clean.count_rejects(picked, text).where("rejects > 0").collect()]
        if bad:
            raise ValueError("cells that are not numbers: " + ", ".join(f"{r[0]}={r[1]}" for r in bad))
    numbers = clean.sentinel_to_null(picked, spec.names)
    whole = clean.drop_rows_any_null(clean.inf_to_null(numbers, spec.names), spec.names)
    return rename_by_spec(clean.dedup_keep_first(whole, [n for n, _ in spec.inputs], order), spec)


def parse_literal_list(text) -> Column:
    """Text ``[1.0, nan, inf]`` to an array of doubles; NULL for text that is no list."""
    t = F.regexp_replace(col(text), r"(?i)\bnan\b", "NaN")
    t = F.regexp_replace(t, r"(?i)\binf(inity)?\b", "Infinity")
    return F.from_json(t, "array<double>")
