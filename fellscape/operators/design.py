"""Space-filling designs: each point is computed from its index alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fellscape.functions.columns import col, key_hash, unit_hash
from fellscape.operators.position import hex_bucket, hex_digits, position_in_buckets
from fellscape.operators.rescale import Bounds, rescale_affine

# Published Joe-Kuo primitive polynomials (degree, coefficients) and initial
# direction numbers of dimensions 2 to 21; dimension 1 is the van der Corput sequence.
JOE_KUO = [
    (1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]),
    (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17]), (5, 4, [1, 1, 5, 5, 5]), (5, 7, [1, 1, 7, 11, 19]),
    (5, 11, [1, 1, 5, 1, 1]), (5, 13, [1, 1, 1, 3, 11]), (5, 14, [1, 3, 5, 5, 31]),
    (6, 1, [1, 3, 3, 9, 7, 49]), (6, 13, [1, 1, 1, 15, 21, 21]), (6, 16, [1, 3, 1, 13, 27, 49]),
    (6, 19, [1, 1, 1, 15, 7, 5]), (6, 22, [1, 3, 1, 15, 13, 25]), (6, 25, [1, 1, 5, 5, 19, 61]),
    (7, 1, [1, 3, 7, 11, 23, 15, 103]), (7, 4, [1, 3, 7, 13, 13, 15, 69]),
]
METHODS = ("sobol", "halton", "lhs", "random")


def direction_numbers(dim: int, bits: int) -> list[int]:
    """Direction numbers of one dimension (0-based), scaled to ``bits`` bits."""
    if dim == 0:
        return [1 << (bits - 1 - k) for k in range(bits)]
    if dim > len(JOE_KUO):
        raise ValueError(f"direction numbers are given for {len(JOE_KUO) + 1} dimensions")
    degree, poly, start = JOE_KUO[dim - 1]
    m = list(start[:bits])
    for k in range(degree, bits):
        term = m[k - degree] ^ (m[k - degree] << degree)
        for i in range(1, degree):
            if poly >> (degree - 1 - i) & 1:
                term ^= m[k - i] << i
        m.append(term)
    return [m[k] << (bits - 1 - k) for k in range(bits)]


def primes(n: int) -> list[int]:
    found, c = [], 2
    while len(found) < n:
        if all(c % p for p in found):
            found.append(c)
        c += 1
    return found


def sobol(index: Column, dim: int, n: int) -> Column:
    """Unscrambled Sobol coordinate: XOR of the direction numbers picked by the Gray code of the index."""
    bits = max(1, int(n - 1).bit_length())
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    picked = [(-(F.shiftright(gray, k).bitwiseAND(F.lit(1).cast("long")))).bitwiseAND(F.lit(v).cast("long"))
              for k, v in enumerate(direction_numbers(dim, bits))]
    return reduce(lambda a, b: a.bitwiseXOR(b), picked).cast("double") / F.lit(float(1 << bits))


def halton(index: Column, base: int, n: int) -> Column:
    """Unscrambled Halton coordinate: the digits of the index mirrored at the point."""
    terms, power = [], 1
    while power < max(n, 2):
        digit = F.floor(index / F.lit(power)) % F.lit(base) if power > 1 else index % F.lit(base)
        terms.append(digit.cast("double") / F.lit(float(power * base)))
        power *= base
    return reduce(lambda a, b: a + b, terms)


def uniform(index: Column, dim: int, seed: int) -> Column:
    return unit_hash(seed, dim, index)


def latin_hypercube(ids: DataFrame, index: str, names: Sequence[str], n: int, seed: int) -> DataFrame:
    """One point per stratum and dimension: strata are ranks of seeded hashes, places are random."""
    source, out, digits = ids.select(index), ids, hex_digits(n)
    for j, name in enumerate(names):
        h = key_hash(f"perm{seed}", j, col(index))
        out = position_in_buckets(out, hex_bucket(h, digits), [h, col(index)], "_stratum", source=source)
        out = out.withColumn(name, (F.col("_stratum") + uniform(col(index), j, seed)) / F.lit(float(n))).drop("_stratum")
    return out


def unit_design(ids: DataFrame, index: str, method: str, names: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Points of the unit cube for 0-based indices below ``n``."""
    i = col(index).cast("long")
    if method == "lhs":
        return latin_hypercube(ids, index, names, n, seed)
    if method == "sobol":
        coords = [sobol(i, j, n) for j in range(len(names))]
    elif method == "halton":
        coords = [halton(i, b, n) for b in primes(len(names))]
    elif method == "random":
        coords = [uniform(i, j, seed) for j in range(len(names))]
    else:
        raise ValueError(f"{method} is not defined, use one of {METHODS}")
    return ids.select("*", *[c.alias(name) for c, name in zip(coords, names)])


def doe_scale(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Unit cube to bounds."""
    return rescale_affine(df, Bounds.cube(bounds.names, 0.0, 1.0), bounds)


def doe_round(df: DataFrame, names: Sequence[str], round_off: int | bool) -> DataFrame:
    """Round half to even at ``round_off`` decimals; False and 0 leave the values alone."""
    if not round_off:
        return df
    grid = F.lit(10.0 ** int(round_off))
    return df.select(*[(F.rint(col(c) * grid) / grid).alias(c) if c in names else col(c) for c in df.columns])


def check_design(method: str, n: int, lower: Sequence[float], upper: Sequence[float]) -> None:
    if method not in METHODS:
        raise ValueError(f"{method} is not defined, use one of {METHODS}")
    if n <= 0:
        raise ValueError("the sample size must be positive")
    if len(lower) != len(upper):
        raise ValueError(f"{len(lower)} lower but {len(upper)} upper bounds")
    if any(hi <= lo for lo, hi in zip(lower, upper)):
        raise ValueError("every upper bound must exceed its lower bound")


def doe_create(spark: SparkSession, method: str, n: int, lower: Sequence[float], upper: Sequence[float],
               round_off: int | bool = False, seed: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """A design of ``n`` points within bounds, as ``(sample_id, x1..xd)``.

    ``ids`` may give the 0-based ``sample_id`` of each point; otherwise they are counted up.
    """
    check_design(method, n, lower, upper)
    names = [f"x{j + 1}" for j in range(len(lower))]
    ids = ids if ids is not None else spark.range(n).withColumnRenamed("id", "sample_id")
    unit = unit_design(ids, "sample_id", method, names, n, seed)
    return doe_round(doe_scale(unit, Bounds(tuple(names), tuple(lower), tuple(upper))), names, round_off)
