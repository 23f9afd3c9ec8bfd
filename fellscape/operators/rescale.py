"""Affine rescaling of inputs and normalisation of responses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fellscape.functions.columns import col
from fellscape.operators.clean import dedup_keep_first
from fellscape.session import broadcast_checked


@dataclass(frozen=True)
class Bounds:
    """Declared limits of the inputs, in input order."""

    names: tuple[str, ...]
    lower: tuple[float, ...]
    upper: tuple[float, ...]

    def __post_init__(self):
        if not len(self.names) == len(self.lower) == len(self.upper):
            raise ValueError(f"{len(self.names)} inputs, {len(self.lower)} lower and {len(self.upper)} upper bounds")

    @classmethod
    def cube(cls, names: Sequence[str], lower: float = -5.0, upper: float = 5.0) -> "Bounds":
        names = tuple(names)
        return cls(names, (float(lower),) * len(names), (float(upper),) * len(names))


def affine(v: Column, bmin: float, bmax: float, tmin: float, tmax: float) -> Column:
    return (v - F.lit(float(bmin))) / F.lit(float(bmax - bmin)) * F.lit(float(tmax - tmin)) + F.lit(float(tmin))


def rescale_affine(df: DataFrame, bounds: Bounds, target: Bounds) -> DataFrame:
    """Map declared bounds onto target bounds; values outside are not clipped."""
    at = {n: i for i, n in enumerate(bounds.names)}

    def scaled(c):
        i = at[c]
        return affine(col(c), bounds.lower[i], bounds.upper[i], target.lower[i], target.upper[i]).alias(c)

    return df.select(*[scaled(c) if c in at else col(c) for c in df.columns])


def validate_doe(df: DataFrame, bounds: Bounds, responses: Sequence[str], target: Bounds | None = None,
                 normalize_x: bool = True) -> DataFrame:
    """Driver checks plus one aggregate: every input and response must be there on every row."""
    missing = [c for c in [*bounds.names, *responses] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    if normalize_x and (target is None or len(target.names) != len(bounds.names)):
        raise ValueError("normalising the inputs needs target bounds for each of them")
    row = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count(col(c)).alias(f"n_{i}") for i, c in enumerate([*bounds.names, *responses])])
    first = row.first()
    short = [c for i, c in enumerate([*bounds.names, *responses]) if first[f"n_{i}"] != first["n_rows"]]
    if short:
        raise ValueError(f"missing values in {short}")
    return df.sparkSession.createDataFrame(
        [(len(bounds.names), len(responses), first["n_rows"])], "n_inputs int, n_responses int, n_rows long")


def preprocess(df: DataFrame, bounds: Bounds, order: str, target: Bounds | None) -> DataFrame:
    """Unique input points (first row wins), inputs rescaled when a target is given."""
    points = dedup_keep_first(df, bounds.names, order)
    return rescale_affine(points, bounds, target) if target is not None else points


def normalize_response(df: DataFrame, keys: Sequence[str], responses: Sequence[str],
                       bound: int | None = None) -> DataFrame:
    """``(y - min) / (max - min)`` within each group; a constant response becomes NULL."""
    lo = [F.min(col(c)).alias(f"_lo{i}") for i, c in enumerate(responses)]
    hi = [F.max(col(c)).alias(f"_hi{i}") for i, c in enumerate(responses)]
    stats = broadcast_checked(df.groupBy(*keys).agg(*lo, *hi), bound)
    at = {c: i for i, c in enumerate(responses)}

    def scaled(c):
        i = at[c]
        return F.try_divide(col(c) - F.col(f"_lo{i}"), F.col(f"_hi{i}") - F.col(f"_lo{i}")).alias(c)

    return df.join(stats, list(keys)).select(*[scaled(c) if c in at else col(c) for c in df.columns])
