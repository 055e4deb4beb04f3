"""Cosine similarity as column expressions in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a length is zero or the sizes differ."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((norm > 0) & (F.size(a) == F.size(b)), _dot(a, b) / norm)


def cosine_to(a: Column, query: list[float]) -> Column:
    """Similarity to one vector, which travels as a literal."""
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    q = F.array(*[F.lit(float(x)) for x in query])
    own = F.sqrt(_dot(a, a))
    return F.when((own > 0) & F.lit(length > 0) & (F.size(a) == len(query)), _dot(a, q) / (own * F.lit(length)))
