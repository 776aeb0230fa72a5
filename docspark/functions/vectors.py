"""Vector functions as column expressions over arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where a vector is null or holds a null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def normalize(a: Column) -> Column:
    """Unit length; an all-zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def truncate(a: Column, dims: int) -> Column:
    """The first ``dims`` entries at unit length."""
    return normalize(F.slice(a, 1, dims))


def sparse_dot(ai: Column, av: Column, bi: Column, bv: Column) -> Column:
    """Dot product of two sparse vectors given as parallel arrays of indices and values."""
    other = F.map_from_arrays(bi, bv)
    return F.aggregate(F.zip_with(ai, av, lambda i, v: v * F.coalesce(F.try_element_at(other, i), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def hashed_embedding(terms: Column, dims: int = 64) -> Column:
    """Unit vector of hashed term counts: the default encoder where no model is plugged in."""
    slots = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dims)
    return normalize(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("double")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
