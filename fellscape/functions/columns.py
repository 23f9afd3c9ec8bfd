"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_UNIT = float(1 << 48)
#: Steps per unit for results compared at 3, 4, 6 and 9 decimals.
GRID = {3: 1 << 10, 4: 1 << 14, 6: 1 << 20, 9: 1 << 30}


def col(c: str | Column) -> Column:
    """A column by name; names may hold dots."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NULL for NaN and both infinities: NULL is the only missing value."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def key_hash(*parts: Column | str | int) -> Column:
    """Text hash of a seed and identifiers; the same on every run, partitioning and retry."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def unit_hash(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1) from 48 bits of :func:`key_hash`."""
    return F.conv(F.substring(key_hash(*parts), 1, 12), 16, 10).cast("double") / F.lit(_UNIT)


def tidy(c: str | Column, digits: int = 6) -> Column:
    """Value on a binary grid of about ``digits`` decimals, without a negative zero.

    A binary grid, because averages of decimal data often lie exactly between two decimals.
    """
    grid = F.lit(float(GRID[digits]))
    return F.rint(col(c) * grid) / grid + F.lit(0.0)


def single(c: str | Column) -> Column:
    """Value at single precision (about seven digits), for wide-ranging results."""
    return col(c).cast("float").cast("double") + F.lit(0.0)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
