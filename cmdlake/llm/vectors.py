"""What the vector operators share: which vectors take part, and their Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, *more: str) -> DataFrame:
    """(vec_id, v) with v in double precision, of the rows whose vector takes part."""
    v = F.col("embedding").cast("array<double>")
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *more).where(usable(F.col("v")))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a column of lists without nulls."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out.append((rows, values[starts[rows][:, None] + np.arange(d)]))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
