"""Vector arithmetic as Column expressions on array<double>, in the JVM but for the decoding of half precision."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least norm, and the least denominator of a correlation.
FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once a row, however often `use` names it, within its lambdas too."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column) -> Column:
    """v at length 1; the zero vector stays zero. Vector and length are computed once, so nested operators cost their sum."""

    def scaled(w: Column) -> Column:
        length = F.greatest(F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x)), F.lit(FLOOR))
        return once(length, lambda n: F.transform(w, lambda x: x / n))

    return once(v, scaled)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def to_half(x: Column) -> Column:
    """The nearest half-precision number, ties to even, of a finite number in its range."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(F.abs(x), F.lit(1e-300)))), F.lit(-14)) - 10)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x / step) * step)


def from_half_bytes(b: Column) -> Column:
    """array<double> of little-endian half-precision numbers, decoded in Arrow batches; infinities and NaN stay what they are.

    A null stays null; an odd last byte is left out.
    """

    def decode(blobs: pa.Array) -> pa.Array:
        import numpy as np

        blobs = blobs.cast(pa.large_binary())
        n = len(blobs)
        offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + n + 1]
        data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets) & ~1
        if (np.diff(offsets) != sizes).any():
            data = np.concatenate([data[a : a + k] for a, k in zip(offsets, sizes)])
        else:
            data = data[offsets[0] : offsets[-1]]
        ends = np.concatenate([[0], np.cumsum(sizes)]) // 2
        values = data[: int(ends[-1]) * 2].tobytes()
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(values, "<f2").astype(np.float64)), mask=blobs.is_null())
        return lists.cast(pa.list_(pa.float64()))

    # Spark takes the kind of function from the types themselves, which are strings in this module
    decode.__annotations__ = {"blobs": pa.Array, "return": pa.Array}
    return F.arrow_udf(decode, "array<double>")(b)

