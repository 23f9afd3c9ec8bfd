"""Cleaning of wide numeric tables: one aggregate pass per decision, no row leaves the cluster."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from fellscape.functions.columns import col, finite
from fellscape.operators.position import add_position

SENTINEL = "EXPRESSION_ERROR"  # fixed value: text marking a failed simulation


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def inf_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = set(columns if columns is not None else double_columns(df))
    return df.select(*[finite(c).alias(c) if c in columns else col(c) for c in df.columns])


def fill_null(df: DataFrame, value: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells take ``value``; any value but None counts, zero included."""
    columns = set(columns if columns is not None else double_columns(df))
    return df.select(*[F.coalesce(col(c), F.lit(value)).alias(c) if c in columns else col(c) for c in df.columns])


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: str = SENTINEL) -> DataFrame:
    """Numbers kept as text become doubles; the sentinel and blanks become NULL."""
    def number(c):
        text = F.nullif(F.trim(col(c).cast("string")), F.lit(sentinel))
        return F.nullif(text, F.lit("")).try_cast("double")

    wanted = set(columns)
    return df.select(*[number(c).alias(c) if c in wanted else col(c) for c in df.columns])


def count_rejects(df: DataFrame, columns: Sequence[str], sentinel: str = SENTINEL) -> DataFrame:
    """Cells per column that are neither a number, blank nor the sentinel."""
    def bad(c):
        text = F.trim(col(c).cast("string"))
        return F.count_if((text != "") & (text != sentinel) & text.try_cast("double").isNull())

    row = df.agg(*[bad(c).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column_name", "rejects")


def drop_rows_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns if columns is not None else df.columns)
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in names))


def dedup_keep_first(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """One row per distinct input point, the one with the smallest ``order``, which must be unique.

    One aggregate with map-side combine: a point copied a billion times is reduced before the
    shuffle, where a window would sort all its copies in one task. Every column is followed on its
    own, so that numbers stay in hash aggregation; a struct or text would make Spark sort.
    """
    rest = [c for c in df.columns if c not in columns]
    first = df.groupBy(*[col(c) for c in columns]).agg(
        *[(F.min(col(c)) if c == order else F.min_by(col(c), col(order))).alias(c) for c in rest])
    return first.select(*[col(c) for c in df.columns])


def dup_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows dropped and kept by de-duplication; counted by group so that no task holds a hot point."""
    per_point = df.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    return per_point.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("dropped"),
        F.count(F.lit(1)).alias("kept"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Non-missing count, minimum and maximum of every column, in one aggregate row."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(col(c)).alias(f"n{i}"), F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: {"rows": row["rows"], "n": row[f"n{i}"], "lo": row[f"lo{i}"], "hi": row[f"hi{i}"]}
            for i, c in enumerate(columns)}


def nunique_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-missing values per column, from per-(column, value) groups."""
    cells = df.unpivot([], [col(c) for c in columns], "feature", "value").where(F.col("value").isNotNull())
    per = cells.groupBy("feature", "value").agg(F.lit(1).alias("one")).groupBy("feature").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(per, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n_unique"))


def matching_columns(columns: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Columns hit by any pattern; a pattern may match anywhere in the name."""
    return [c for c in columns if any(re.search(p, c) for p in patterns)]


def drop_cols_by_regex(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return drop_cols_by_name(df, matching_columns(df.columns, patterns))


def drop_features_by_regex(df: DataFrame, patterns: Sequence[str], feature: str = "feature") -> DataFrame:
    """Long-layout form: drop rows whose feature name matches."""
    for p in patterns:
        df = df.where(~col(feature).rlike(p))
    return df


def drop_cols_by_name(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in set(names)])


def all_null(profile: dict) -> list[str]:
    return [c for c, p in profile.items() if p["n"] == 0]


def any_null(profile: dict) -> list[str]:
    return [c for c, p in profile.items() if p["n"] < p["rows"]]


def constant(profile: dict) -> list[str]:
    """Exactly one distinct non-missing value; an all-missing column has none and stays."""
    return [c for c, p in profile.items() if p["n"] > 0 and p["lo"] == p["hi"]]


def drop_cols_all_null(df: DataFrame) -> DataFrame:
    return drop_cols_by_name(df, all_null(column_profile(df, df.columns)))


def drop_cols_any_null(df: DataFrame) -> DataFrame:
    return drop_cols_by_name(df, any_null(column_profile(df, df.columns)))


def drop_cols_constant(df: DataFrame) -> DataFrame:
    return drop_cols_by_name(df, constant(column_profile(df, df.columns)))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def reindex(df: DataFrame, order: str, out: str = "row_id") -> DataFrame:
    """Dense 0-based id in the order of a unique numeric column."""
    return add_position(df, order, out)


def clean_table(
    df: DataFrame,
    *,
    inf_as_null: bool = False,
    replace_null: float | None = None,
    filter_keys: Sequence[str] = (),
    cols_all_null: bool = False,
    cols_any_null: bool = False,
    rows_any_null: bool = False,
    cols_constant: bool = True,
    duplicate_rows: bool = True,
    reindex_by: str | None = None,
    id_columns: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The cleaning steps in their fixed order; returns the table and a report of dropped columns.

    ``id_columns`` are carried through and never judged. Dropping incomplete rows changes which
    columns are constant, so only then is the table profiled a second time.
    """
    spark, dropped = df.sparkSession, []
    ids = list(id_columns)

    def drop(df, names, step):
        dropped.extend((step, c) for c in names)
        return drop_cols_by_name(df, names)

    def values(df):
        return [c for c in df.columns if c not in ids]

    if inf_as_null:
        df = inf_to_null(df)
    if replace_null is not None:
        df = fill_null(df, replace_null)
    if filter_keys:
        df = drop(df, matching_columns(values(df), filter_keys), "filter")
    profile = column_profile(df, values(df)) if (cols_all_null or cols_any_null or (cols_constant and not rows_any_null)) else None
    if cols_all_null:
        df = drop(df, all_null(profile), "all_null")
    if cols_any_null:
        df = drop(df, [c for c in any_null(profile) if c in df.columns], "any_null")
    if rows_any_null:
        df = drop_rows_any_null(df, values(df))
    if cols_constant:
        if rows_any_null:
            profile = column_profile(df, values(df))
        df = drop(df, [c for c in constant(profile) if c in df.columns], "constant")
    if duplicate_rows:
        df = drop_duplicate_rows(df)
    if reindex_by:
        df = reindex(df, reindex_by)
    return df, spark.createDataFrame(dropped, "step string, feature string")


def dropped_columns_report(before: DataFrame, after: DataFrame, feature: str = "feature") -> DataFrame:
    """Features present before and absent after, in the long layout."""
    return before.select(feature).distinct().join(after.select(feature).distinct(), feature, "left_anti")
