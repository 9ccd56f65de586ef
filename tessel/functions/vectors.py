"""Vector functions: dot product, block quantisation, stored forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, MULTIPLE = 32, 256


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null unless the sizes agree."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def padded(v: Column) -> Column:
    """``v`` filled up with zeros to a multiple of 256 values."""
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.pmod(-F.size(v), F.lit(MULTIPLE))))


def checked(v: Column) -> Column:
    """``v``; an error unless it has a positive multiple of 256 values."""
    wrong = (F.size(v) <= 0) | (F.size(v) % MULTIPLE != 0)
    return F.when(wrong, F.raise_error(F.lit("vector size must be a positive multiple of 256"))).otherwise(v)


def blocks(v: Column) -> Column:
    """Blocks of 32 values as (scale, q): the scale in float32, values rounded half up on the float32 quotient."""

    def scaled(part: Column) -> Column:
        top = F.array_max(F.transform(F.filter(part, lambda x: ~F.isnan(x)), lambda x: F.abs(x)))
        scale = F.when(F.coalesce(top, F.lit(0.0)) == 0, F.lit(1.0).cast("float")).otherwise((top / 127).cast("float"))
        return F.struct(part.alias("part"), scale.alias("scale"))

    def rounded(block: Column) -> Column:
        def value(x: Column) -> Column:
            q = F.greatest(F.least(F.floor((x / block["scale"]).cast("float").cast("double") + 0.5), F.lit(127)), F.lit(-128))
            tiny = F.when(x > 0, 127).when(x < 0, -128).otherwise(0)  # the scale of a block of subnormal values may be 0
            return F.when(F.isnan(x), 0).when(block["scale"] == 0, tiny).otherwise(q).cast("byte")

        return F.struct(block["scale"].alias("scale"), F.transform(block["part"], value).alias("q"))

    # One step after the other, so that a block's scale is computed once and not for each value.
    parts = F.transform(F.sequence(F.lit(0), (F.size(v) / BLOCK).cast("int") - 1), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
    return F.transform(F.transform(parts, scaled), rounded)


def _alike(values: pd.Series, each) -> pd.Series:
    """``each`` over all values of one size at once; null stays null."""
    sizes = values.map(lambda x: -1 if x is None else len(x))
    out = pd.Series([None] * len(values), dtype=object)
    for size in set(sizes) - {-1}:
        own = np.flatnonzero(sizes == size)
        for k, x in zip(own.tolist(), each([values.iloc[k] for k in own.tolist()]), strict=True):
            out.iat[k] = x
    return out


@F.pandas_udf(T.BinaryType())
def q8_bytes(v: pd.Series) -> pd.Series:
    """34 bytes a block: the scale as little-endian float16, then 32 signed bytes."""
    return _alike(v, lambda rows: [x.tobytes() for x in q8_encoded(np.stack(rows).astype(np.float32))])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def q8_values(data: pd.Series) -> pd.Series:
    """The values of stored blocks, with the rounded scale."""
    return _alike(data, lambda rows: list(q8_decode(b"".join(rows)).reshape(len(rows), -1)))


def q8_encoded(v: np.ndarray) -> np.ndarray:
    """Stored bytes (n, bytes) of vectors (n, size)."""
    if not v.shape[1] or v.shape[1] % MULTIPLE:
        raise ValueError("vector size must be a positive multiple of 256")
    part = v.reshape(-1, BLOCK)
    top = np.nan_to_num(np.abs(part), nan=0.0, posinf=np.inf).max(1)
    scale = np.where(top == 0, np.float32(1), (top / np.float32(127)).astype(np.float32)).astype(np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):  # the scale of a block of subnormal values may be 0
        q = np.floor((part / scale[:, None]).astype(np.float32).astype(np.float64) + 0.5)
    out = np.empty((len(part), 2 + BLOCK), np.uint8)
    with np.errstate(over="ignore"):
        out[:, :2] = scale.astype("<f2").view(np.uint8).reshape(-1, 2)
    out[:, 2:] = np.clip(np.nan_to_num(q), -128, 127).astype(np.int8).view(np.uint8)
    return out.reshape(len(v), -1)


def q8_encode(v: np.ndarray) -> bytes:
    return q8_encoded(v[None, :]).tobytes()


def q8_decode(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 2 + BLOCK)
    scale = raw[:, :2].copy().view("<f2").astype(np.float32)
    return (raw[:, 2:].view(np.int8).astype(np.float32) * scale).ravel()


@F.pandas_udf(T.BinaryType())
def f32_bytes(v: pd.Series) -> pd.Series:
    """Big-endian float32 values."""
    return _alike(v, lambda rows: [x.tobytes() for x in np.stack(rows).astype(">f4")])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def f32_values(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, ">f4").astype(np.float32))
