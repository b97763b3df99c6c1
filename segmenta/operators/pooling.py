"""Pooling of vectors: over groups, over spans of token rows, and pools of pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("mean", "max", "min", "sum", "median")
#: Dimensions up to which a group's pool is one aggregate for each; beyond, rows are exploded by dimension.
WIDE = 200


def _aggregate(method: str):
    if method not in METHODS:
        raise ValueError(f"pooling method must be one of {METHODS}")
    return {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "median": F.median}[method]


def pool_columns(vector: Column, dim: int, method: str) -> Column:
    """The aggregate ``array<double>`` over a group; null over no rows."""
    f = _aggregate(method)
    made = F.array(*[f(F.get(vector, F.lit(d)).cast("double")) for d in range(dim)])
    return F.when(F.count(vector) > 0, made)


def pool(df: DataFrame, keys: list[str], vector: str, dim: int, method: str = "mean", out: str = "embedding", extra: dict[str, Column] | None = None) -> DataFrame:
    """A row for each group: ``keys``, ``extra`` aggregates by name, and the pooled vector."""
    more = [c.alias(name) for name, c in (extra or {}).items()]
    if dim <= WIDE:
        return df.groupBy(*keys).agg(*more, pool_columns(F.col(vector), dim, method).alias(out))
    long = df.select(*keys, F.posexplode(vector).alias("d", "x"))
    by_dim = long.groupBy(*keys, "d").agg(_aggregate(method)(F.col("x").cast("double")).alias("x"))
    wide = by_dim.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("all")).select(*keys, F.col("all.x").alias(out))
    return df.groupBy(*keys).agg(*more).join(wide, keys, "left") if more else wide


def pool_array(vectors: Column, method: str = "mean") -> Column:
    """The pool of an ``array`` of vectors of one length; null over none.  Medians need rows."""
    over = {"mean": lambda a, b: a + b, "sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
    if method not in over:
        raise ValueError(f"pooling method must be one of {tuple(over)}")
    first = F.get(vectors, F.lit(0)).cast("array<double>")
    folded = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), first, lambda a, v: F.zip_with(a, v.cast("array<double>"), over[method]))
    return F.transform(folded, lambda x: x / F.size(vectors)) if method == "mean" else folded


def pool_frame(tokens: DataFrame, keys: list[str], dim: int, method: str = "mean") -> DataFrame:
    """Pool a token frame, and keep its tokens in order."""
    return pool(tokens, keys, "embedding", dim, method, extra={"tokens": F.array_sort(F.collect_list(F.struct("pos", "token")))["token"]})


def pool_spans(tokens: DataFrame, spans: DataFrame, dim: int, method: str = "mean", key: str = "doc_id", span: list[str] | None = None) -> DataFrame:
    """A row for each span ``(key, *span, start, end)``, half-open over ``pos``: ``n_tokens`` and the pooled vector, null if it is empty.
    Spans may overlap.  Positions are exploded, so the join is an equi-join on key and position."""
    ids = span or ["span_id"]
    places = spans.where("start < end").select(key, *ids, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    met = places.join(tokens.select(key, "pos", "embedding"), [key, "pos"])
    pooled = pool(met, [key, *ids], "embedding", dim, method, extra={"n_tokens": F.count(F.lit(1))})
    return spans.join(pooled, [key, *ids], "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))


def late_pool(tokens: DataFrame, spans: DataFrame, dim: int, key: str = "doc_id", span: list[str] | None = None, strict_end: bool = False) -> DataFrame:
    """Mean of each span's token vectors; a zero vector for a span that is empty or begins beyond the text.  An end beyond the text is
    the text's end, or with ``strict_end`` makes the span invalid."""
    ids = span or ["span_id"]
    if strict_end:
        n = tokens.groupBy(key).agg((F.max("pos") + 1).alias("n"))
        spans = spans.join(n, key, "left").withColumn("end", F.when(F.col("end") <= F.coalesce("n", F.lit(0)), F.col("end")).otherwise(F.col("start"))).drop("n")
    got = pool_spans(tokens, spans, dim, "mean", key, ids)
    return got.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)))


def mean_of_positive(score: Column) -> Column:
    """The mean of positive scores; 0 if there are none."""
    return F.coalesce(F.avg(F.when(score > 0, score)), F.lit(0.0))
