"""Functions applied to sample points: benchmark functions, generated functions, user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fellscape.functions.benchmarks import add_function
from fellscape.functions.columns import col
from fellscape.functions.expression import add_expression
from fellscape.functions.program import ARRAYS, Program
from fellscape.operators.tables import to_long

#: Operations of a stack of projections that compile into one method of the stage; larger programs run over Arrow batches.
MOST_OPERATIONS = 500
BATCH_CELLS = 1 << 14
Writer = Callable[[Program, Sequence[str]], str]


def _inputs(batch: pa.RecordBatch, d: int) -> tuple[dict[str, np.ndarray], np.ndarray | None]:
    """Coordinates by working name, and which points lack one."""
    columns = [batch.column(f"_x{k}") for k in range(d)]
    lacks = [np.asarray(c.is_null()) for c in columns if c.null_count]
    return {f"_x{k}": c.to_numpy(zero_copy_only=False) for k, c in enumerate(columns)}, reduce(np.logical_or, lacks) if lacks else None


def _over_arrays(points: DataFrame, x: Sequence[str], keep: Sequence[str], prog: Program) -> DataFrame:
    """The kept columns and all outputs of a program, computed on Arrow batches."""
    d, kept = len(x), [f"_k{k}" for k in range(len(keep))]
    source = _coordinates(points, x, *zip(keep, kept))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_CELLS):
                batch = whole.slice(start, BATCH_CELLS)
                inputs, lacks = _inputs(batch, d)
                columns = [pa.array(y, mask=lacks) for _, y in prog.values(inputs)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=kept + [f"_y{k}" for k in range(len(columns))])

    fields = [T.StructField(n, source.schema[n].dataType) for n in kept] + [T.StructField(f"_y{k}", T.DoubleType()) for k in range(len(prog.outputs))]
    done = source.mapInArrow(run, T.StructType(fields))
    return done.select(*[F.col(n).alias(c) for n, c in zip(kept, keep)], *[F.col(f"_y{k}").alias(n) for k, n in enumerate(prog.outputs)])


def _evaluate(points: DataFrame, x: Sequence[str], keep: Sequence[str], writers: Sequence[Writer]) -> tuple[DataFrame, list[str]]:
    """All functions side by side: as projections while their code compiles with the stage, else over Arrow batches.

    A point with a missing coordinate has no values in the second form.
    """
    prog = Program()
    names = [w(prog, x) for w in writers]
    if prog.size() <= MOST_OPERATIONS:
        return prog.apply(points, keep), names
    prog = Program(ARRAYS)
    for w in writers:
        w(prog, [f"_x{k}" for k in range(len(x))])
    return _over_arrays(points, x, keep, prog), names


def benchmark_columns(points: DataFrame, x: Sequence[str], functions: Sequence[tuple[int, int]],
                      keep: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """One column per ``(fid, iid)``; returns the table and the column names."""
    writers = [lambda prog, at, f=f, i=i: add_function(prog, at, f, i) for f, i in functions]
    return _evaluate(points, x, keep if keep is not None else points.columns, writers)


def expression_columns(points: DataFrame, x: Sequence[str], catalogue: Sequence, keep: Sequence[str] | None = None,
                       semantics: str = "text") -> tuple[DataFrame, list[str]]:
    """One column per catalogue row (``name, rpn, consts, rots``)."""
    writers = [lambda prog, at, r=r: add_expression(prog, at, r["name"], r["rpn"], r["consts"], r["rots"], semantics)
               for r in catalogue]
    return _evaluate(points, x, keep if keep is not None else points.columns, writers)


def _programs(x: Sequence[str], catalogue: Sequence, semantics: str) -> list[tuple[str, Program]]:
    """One program over working names per catalogue row."""
    out = []
    for r in catalogue:
        prog = Program(ARRAYS)
        add_expression(prog, [f"_x{k}" for k in range(len(x))], r["name"], r["rpn"], r["consts"], r["rots"], semantics)
        out.append((r["name"], prog))
    return out


def _coordinates(points: DataFrame, x: Sequence[str], *keep: tuple[str, str]) -> DataFrame:
    return points.select(*[col(c).alias(n) for c, n in keep], *[col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(x)])


def expression_rows(points: DataFrame, x: Sequence[str], catalogue: Sequence, id_col: str = "sample_id", semantics: str = "text",
                    label: str = "label", value: str = "y") -> DataFrame:
    """One row per point and catalogue row, for any number of functions: the token lists travel, the points stay."""
    source, d = _coordinates(points, x, (id_col, "_k")), len(x)
    held = points.sparkSession.sparkContext.broadcast(_programs(x, catalogue, semantics))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_CELLS):
                batch = whole.slice(start, BATCH_CELLS)
                inputs, lacks = _inputs(batch, d)
                for name, prog in held.value:
                    (_, y), = prog.values(inputs)
                    yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.repeat(name, batch.num_rows), pa.array(y, mask=lacks)], names=["_k", "_l", "_y"])

    fields = [T.StructField("_k", source.schema["_k"].dataType), T.StructField("_l", T.StringType()), T.StructField("_y", T.DoubleType())]
    return source.mapInArrow(run, T.StructType(fields)).select(F.col("_k").alias(id_col), F.col("_l").alias(label), F.col("_y").alias(value))


def expression_moments(points: DataFrame, x: Sequence[str], catalogue: Sequence, semantics: str = "text") -> DataFrame:
    """``func, n_bad, n, variance`` of every catalogue row in one pass over the points.

    Missing, NaN and infinite values are counted, and the variance is that of the others.  Each task sums up all functions;
    one small row per task and function is shuffled.
    """
    source, d = _coordinates(points, x), len(x)
    held = points.sparkSession.sparkContext.broadcast(_programs(x, catalogue, semantics))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, n, mean, m2 = (np.zeros(len(held.value)) for _ in range(4))
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_CELLS):
                batch = whole.slice(start, BATCH_CELLS)
                inputs, lacks = _inputs(batch, d)
                for k, (_, prog) in enumerate(held.value):
                    (_, y), = prog.values(inputs)
                    good = np.isfinite(y) if lacks is None else np.isfinite(y) & ~lacks
                    y = y[good]
                    bad[k] += len(good) - len(y)
                    if len(y):
                        with np.errstate(all="ignore"):  # squares of huge values may be infinite
                            own, total = y.mean(), n[k] + len(y)
                            m2[k] += ((y - own) ** 2).sum() + (own - mean[k]) ** 2 * n[k] * len(y) / total
                            mean[k] += (own - mean[k]) * len(y) / total
                        n[k] = total
        yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in held.value], pa.string()), *(pa.array(a) for a in (bad, n, mean, m2))],
                                         names=["func", "bad", "n", "mean", "m2"])

    def merged(a, b):
        total = a["n"] + b["n"]
        gap, share = b["mean"] - a["mean"], F.when(total > 0, b["n"] / total).otherwise(0.0)
        return F.struct((a["bad"] + b["bad"]).alias("bad"), total.alias("n"), (a["mean"] + gap * share).alias("mean"),
                        (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2"))

    parts = source.mapInArrow(run, "func string, bad double, n double, mean double, m2 double").groupBy("func")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("bad", "n", "mean", "m2")])
    whole = parts.agg(F.aggregate(F.collect_list(F.struct("bad", "n", "mean", "m2")), zero, merged).alias("all"))
    return whole.select("func", F.col("all.bad").cast("long").alias("n_bad"), F.col("all.n").cast("long").alias("n"),
                        F.when(F.col("all.n") > 0, F.col("all.m2") / F.col("all.n")).alias("variance"))


def apply_functions(points: DataFrame, x: Sequence[str], functions: Sequence[tuple[int, int]], id_col: str = "sample_id") -> DataFrame:
    """Every benchmark function at every point, long layout."""
    wide, names = benchmark_columns(points, x, functions, [id_col, *x])
    return to_long(wide.select(id_col, *names), names)


def map_function(points: DataFrame, x: Sequence[str], fn: Callable, out: str = "y", vectorized: bool = False) -> DataFrame:
    """A user's function over all rows in Arrow batches, for objectives that cannot be written as columns.

    With ``vectorized``, ``fn`` gets an array of points (one per row) and returns their values; else it
    is called with the floats of one point at a time.
    """
    @F.pandas_udf("double")
    def apply(frame: pd.DataFrame) -> pd.Series:
        cells = frame.to_numpy(float)
        return pd.Series(fn(cells) if vectorized else [float(fn(row)) for row in cells.tolist()], dtype="float64")

    return points.withColumn(out, apply(F.struct(*[col(c) for c in x])))


def apply_per_label(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], pd.DataFrame],
                    merge: Callable[[pd.DataFrame], pd.DataFrame], partial_schema: str, schema: str,
                    id_col: str = "sample_id", rows_per_task: int = 100_000) -> DataFrame:
    """A user's kernel per label, as partial results merged per label.

    Groups are salted by the row id into parts of about ``rows_per_task`` rows of the largest
    group, so a hot label is spread over tasks; ``merge`` sees one small row set per part.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    parts = -(-sizes // rows_per_task)
    salted = df.withColumn("_part", F.pmod(F.xxhash64(col(id_col)), F.lit(parts)).cast("int"))

    def with_keys(fn, width):
        def run(key, pdf):
            out = fn(pdf)
            for i in range(len(keys) - 1, -1, -1):
                out.insert(0, keys[i], key[i])
            return out
        return run

    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    parts_df = salted.groupBy(*keys, "_part").applyInPandas(with_keys(partial, len(keys)), f"{key_types}, {partial_schema}")
    return parts_df.groupBy(*keys).applyInPandas(with_keys(merge, len(keys)), f"{key_types}, {schema}")


