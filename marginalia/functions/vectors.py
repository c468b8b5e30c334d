"""Vector expressions on ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def l2_normalize(v: Column) -> Column:
    """Divide by the norm; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def hash_bucket(word: Column, dim: int) -> Column:
    """Stable bucket of a word: the first 32 bits of its MD5, modulo the dimension."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
