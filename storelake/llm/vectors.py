"""Vectors as whole numbers, shared by the operators that count with them exactly.

A component x becomes floor(256 * x).  Results beyond +-2**26 (components beyond
262,144) are cut to that bound, so that sums of products of up to 1,024 components fit in a long.
Vectors may differ in length: a missing component counts as 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
LARGEST = 1 << 26


def all_finite(column: str) -> Column:
    """True for a vector without null or non-finite components (null for a null vector)."""
    return F.forall(F.col(column).cast("array<double>"),
                    lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integer_vectors(table: DataFrame, column: str = "embedding", name: str = "v", scale: int = SCALE) -> DataFrame:
    """Rows whose vector is there and finite, with ``name``: its components as whole numbers."""
    def whole(x):
        return F.greatest(F.least(F.floor(x * F.lit(float(scale))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")

    kept = table.where(F.col(column).isNotNull() & F.coalesce(all_finite(column), F.lit(False)))
    return kept.withColumn(name, F.transform(F.col(column).cast("array<double>"), whole))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers; what a list lacks is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.astype(np.int64).reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out
