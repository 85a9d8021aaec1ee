"""Shared by the operators on vectors: which rows take part, and their components as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components stay below this, so that no sum of products of a few thousand of them leaves a long.
LIMIT = 1 << 24


def whole(vector: Column) -> Column:
    """True where a vector is there and every component is a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double, as int: negative numbers go down too.

    A component of LIMIT or more after scaling raises: its products would not be exact.
    """
    def one(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(y) < LIMIT, y.cast("int")).otherwise(F.raise_error(F.lit("a scaled component is too large for exact sums")).cast("int"))

    return F.transform(vector, one)


def extent(ints: DataFrame, column: str = "q") -> tuple[int, int, int]:
    """Rows, longest vector and largest absolute component of a table of scaled vectors: one aggregate."""
    size = F.coalesce(F.array_max(F.transform(column, lambda x: F.abs(x))), F.lit(0))
    n, width, most = ints.agg(F.count(F.lit(1)), F.max(F.size(column)), F.max(size)).first()
    return n, max(1, width or 0), most or 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype) -> np.ndarray:
    """The vectors of a list column as rows, zeros after the end of shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype)
    if len(values) == out.size:
        out[:] = values.reshape(out.shape)
        return out
    starts = np.cumsum(lengths) - lengths
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(values)) - starts[rows]] = values
    return out
