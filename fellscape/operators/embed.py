"""A two-dimensional view of all populations: projection on the first two principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from fellscape.functions.columns import col


def embed_2d(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("label", "kind")) -> DataFrame:
    """``keep`` columns with ``x0, x1``; rows are centred, and the largest loading of an axis is positive."""
    means = df.agg(*[F.avg(col(c)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    names = [f"_c{k}" for k in range(len(columns))]
    rows = df.select(*keep, *[(col(c) - F.lit(m)).alias(n) for c, m, n in zip(columns, means, names)])
    vectors = VectorAssembler(inputCols=names, outputCol="_v").transform(rows).select(*keep, "_v")
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors)
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    at = vector_to_array("_p")
    return model.transform(vectors).select(*keep, *[(F.get(at, F.lit(k)) * signs[k]).alias(f"x{k}") for k in range(2)])
