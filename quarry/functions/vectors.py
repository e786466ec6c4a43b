"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    length = norm(v)
    return F.transform(v, lambda x: F.coalesce(x.cast("double") / F.nullif(length, F.lit(0.0)), F.lit(0.0)))


def quantize_int8(v: Column) -> Column:
    """Scale by the largest absolute value to -127..127, truncating; null for the zero vector."""
    top = F.nullif(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    return F.transform(v, lambda x: (x.cast("double") * 127.0 / top).cast("tinyint"))


def quantize_scale(v: Column) -> Column:
    top = F.nullif(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    return F.lit(127.0) / top


def mean_vector(v: Column, dims: int) -> Column:
    """Aggregate: position-wise mean.  One hash aggregate with ``dims`` buffers, no row explosion."""
    return F.array(*[F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(dims)])
