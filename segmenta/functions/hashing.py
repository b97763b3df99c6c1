"""A deterministic stand-in for a model's token vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_vector(token: Column, dim: int) -> Column:
    """``array<double>`` in [-1, 1): component d from the md5 of "token:d"."""
    one = lambda d: F.conv(F.substring(F.md5(F.concat(token, F.lit(f":{d}"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0) * 2 - 1
    return F.array(*[one(d) for d in range(dim)])
