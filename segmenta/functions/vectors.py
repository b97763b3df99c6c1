"""Column functions on vectors (``array`` of numbers); arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_MODES = ("clamp", "additive", "raw")
DISTANCES = ("cosine", "euclidean", "manhattan")
SIMILARITIES = ("cosine", "dot_product", "pearson", "manhattan")
SPAN_METRICS = ("cosine", "euclidean", "manhattan", "dot_product", "pearson")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(doubles(u), doubles(v), lambda a, b: a * b))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite or NaN where b is zero."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    at_zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, at_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def normalize(v: Column, mode: str = "clamp", floor: float = 1e-8) -> Column:
    """Unit norm.  ``clamp``: by the norm, at least ``floor``; ``additive``: by the norm plus ``floor``; ``raw``: by the norm,
    so a zero vector gives NaN."""
    if mode not in NORM_MODES:
        raise ValueError(f"mode must be one of {NORM_MODES}")
    n = norm(v)
    if mode == "raw":
        return F.transform(doubles(v), lambda x: ratio(x, n))
    by = F.greatest(n, F.lit(floor)) if mode == "clamp" else n + floor
    return F.transform(doubles(v), lambda x: x / by)


def cosine_similarity(u: Column, v: Column) -> Column:
    return ratio(dot(u, v), norm(u) * norm(v))


def cosine_distance_once(u: Column, v: Column) -> Column:
    """``cosine_distance`` with one root and one division, as SQL over columns writes it; where the product of the squares overflows or vanishes, by norms."""
    squares = dot(u, u) * dot(v, v)
    one = (squares > 1e-290) & (squares < float("inf"))
    return F.when(one, 1 - dot(u, v) / F.sqrt(F.when(one, squares).otherwise(F.lit(1.0)))).otherwise(cosine_distance(u, v))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` decimals by one product and one division, halves away from zero, as SQL engines round doubles; Spark's ``round`` goes by decimal digits."""
    y = F.abs(x) * 10.0**digits
    return F.when(y < 2.0**52, F.signum(x) * F.floor(y + 0.5).cast("double") / 10.0**digits).otherwise(x)


def cosine_distance(u: Column, v: Column) -> Column:
    return 1 - cosine_similarity(u, v)


def euclidean(u: Column, v: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(u), doubles(v), lambda a, b: (a - b) * (a - b))))


def manhattan(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(doubles(u), doubles(v), lambda a, b: F.abs(a - b)))


def pearson(u: Column, v: Column) -> Column:
    centred = lambda x: F.transform(doubles(x), lambda e: e - _sum(doubles(x)) / F.size(x))
    return cosine_similarity(centred(u), centred(v))


_METRICS = {"cosine": cosine_distance, "euclidean": euclidean, "manhattan": manhattan, "dot_product": dot, "pearson": pearson}


def distance(u: Column, v: Column, metric: str = "cosine", allowed: tuple[str, ...] = DISTANCES) -> Column:
    """With ``allowed=SPAN_METRICS`` dot product and correlation serve as "distances" too."""
    if metric not in allowed:
        raise ValueError(f"metric must be one of {allowed}")
    return _METRICS[metric](u, v)


def similarity(u: Column, v: Column, metric: str = "cosine") -> Column:
    if metric not in SIMILARITIES:
        raise ValueError(f"metric must be one of {SIMILARITIES}")
    if metric == "cosine":
        return cosine_similarity(u, v)
    if metric == "manhattan":
        return 1 / (1 + manhattan(u, v))
    return _METRICS[metric](u, v)
