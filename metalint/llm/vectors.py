"""Vectors of real numbers as whole-number matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True where the vector is neither null nor holds a null or a component that isn't finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def component_limit(width: int) -> int:
    """Scaled components are clipped here, so that a squared distance of whole vectors stays within 62 bits."""
    return int(2**30 / np.sqrt(max(width, 1)))


def scaled(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of every component as int64, a row for each vector; shorter vectors go on with zeros.

    No vector is null or longer than width.
    """
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    limit = component_limit(width)
    whole = np.clip(np.floor(scale * values), -limit, limit).astype(np.int64)
    if (lengths == width).all():
        return whole.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = whole
    return out


def extent(rows: DataFrame, vector: str) -> tuple[int, int]:
    """Number of rows and components of the longest vector (at least 1)."""
    n, width = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    return n, max(width or 1, 1)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers as int64, through floats where these are exact."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
