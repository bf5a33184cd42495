"""Vector functions."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from factloom.functions.text import tokens_of


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the length both have; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when(norm > 0, _dot(x, y) / norm).otherwise(F.lit(0.0))


def cosine_of(a, b) -> float:
    n = min(len(a), len(b))
    dot = sum(x * y for x, y in zip(a[:n], b[:n], strict=True))
    norm = math.sqrt(sum(x * x for x in a[:n])) * math.sqrt(sum(y * y for y in b[:n]))
    return dot / norm if norm else 0.0


@lru_cache(1 << 16)
def _signed_hash(token: str) -> int:
    h = 2166136261
    for unit in memoryview(token.encode("utf-16-le", "surrogatepass")).cast("H"):
        h = (h ^ unit) * 16777619 % 2**32
    return h - 2**32 if h >= 2**31 else h


def hash_vector(text: str | None, dims: int = 256) -> list[float]:
    """A signed hashed bag of tokens of length one: 32-bit FNV-1a over UTF-16 units."""
    out = [0.0] * dims
    for token in tokens_of(text):
        signed = _signed_hash(token)
        out[abs(signed) % dims] += -1.0 if signed < 0 else 1.0
    norm = math.sqrt(sum(v * v for v in out))
    return [v / norm for v in out] if norm else out


def hash_embed(dims: int = 256):
    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hash_vector(t, dims))

    return embed


def from_text(text: Column) -> Column:
    """A vector written as [1,2,3]; null where the text is none."""
    return F.from_json(text, "array<double>")


def to_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("double").cast("string")), ","), F.lit("]"))
