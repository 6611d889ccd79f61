"""Shared array helpers for operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def components_of(df: DataFrame, name: str) -> Column:
    """The array column ``name`` as it is where it holds floats, else in doubles, so no component loses digits."""
    return F.col(name) if df.schema[name].dataType.simpleString() == "array<float>" else F.col(name).cast("array<double>")


def usable(vec: Column) -> Column:
    """True for a vector that is not null, not zero and holds only finite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """The rows of a list column that all have ``dim`` elements, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), dim)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine for one seed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return np.round(q * np.sign(np.diag(r)), 9)


def rotate(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``x @ q`` added up in a fixed order, so that a row gets the same bits in whatever block it is."""
    out = np.zeros((len(x), q.shape[1]))
    for j in range(q.shape[0]):
        out += x[:, j, None] * q[j]
    return out
