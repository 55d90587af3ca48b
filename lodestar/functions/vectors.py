"""Vector expressions over ``array<double>`` columns (V1-V8).

Everything here is a built-in Catalyst expression (higher-order functions),
so it stays inside whole-stage code generation; the numpy helpers at the end
are for the Arrow-batched block kernels.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS_NORM = 1e-12  # fixed value: floor of the norm in L2 normalisation


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    """V8 (inverse): compute in double."""
    return _c(c).cast("array<double>")


def as_float(c) -> Column:
    """V8: float32 storage cast."""
    return _c(c).cast("array<float>")


def dot(a, b) -> Column:
    """V2: row-wise dot product."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def axpy(alpha, x, beta, y) -> Column:
    """V5: ``alpha*x + beta*y`` element-wise; alpha/beta are scalars or columns."""
    al = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else _c(alpha)
    be = F.lit(float(beta)) if isinstance(beta, (int, float)) else _c(beta)
    return F.zip_with(_c(x), _c(y), lambda p, q: al * p + be * q)


DOUBLE_MAX = 1.7976931348623157e308  # fixed value: largest finite double


def nan_to_zero(a) -> Column:
    """V6 (``nan_to_num``): NaN -> 0, ±inf -> ±largest finite double."""
    inf = F.lit(float("inf"))
    return F.transform(_c(a), lambda x: F.when(F.isnan(x), F.lit(0.0))
                       .when(x == inf, F.lit(DOUBLE_MAX))
                       .when(x == -inf, F.lit(-DOUBLE_MAX)).otherwise(x))


def with_normalized(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """V1: ``x / max(||x||, 1e-12)``; the norm is materialised once per row."""
    out = out or col
    tmp = f"__norm_{col}"
    return (df.withColumn(tmp, F.greatest(norm(col), F.lit(EPS_NORM)))
              .withColumn(out, F.transform(F.col(col), lambda x: x / F.col(tmp)))
              .drop(tmp))


def select_when(mask, a, b) -> Column:
    """V7: masked select without multiplying NaN through."""
    return F.when(_c(mask), _c(a)).otherwise(_c(b))


def vector_sum(c) -> Column:
    """V4: element-wise vector sum aggregate.

    Uses the ML ``Summarizer`` (a typed imperative aggregate with map-side
    partial aggregation), so a hot key never pulls its rows into one task.
    A group without rows does not exist; callers left-join and fill zeros.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return vector_to_array(Summarizer.sum(array_to_vector(_c(c))), "float64")


def zeros_like(c) -> Column:
    return F.transform(_c(c), lambda x: F.lit(0.0))


# --------------------------------------------------------------------------
# numpy / Arrow helpers for block kernels
# --------------------------------------------------------------------------

def list_to_matrix(arr: pa.Array) -> np.ndarray:
    """Arrow ``list<double|float>`` column -> dense 2-D float64 matrix."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    flat = np.array(arr.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(n, -1)


def matrix_to_list(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1), type=pa.float64()))


def np_normalize(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.maximum(n, EPS_NORM)
