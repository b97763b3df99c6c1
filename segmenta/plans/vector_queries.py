"""Queries over the table of vectors: pools, norms, distances, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.functions import vectors as V
from segmenta.operators import pooling
from segmenta.plans.common import dims, r6, table

DIM = 64
SPANS = [(0, 0, 5), (1, 5, 10), (2, 10, 15), (3, 3, 12), (4, 100, 150)]
#: With empty spans, a start beyond the text and an end beyond it.
ODD_SPANS = [*SPANS, (5, 7, 7), (6, 9, 4), (7, 1_000_000, 1_000_001), (8, 490, 1_000_000)]


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as the token frame of one document."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).cast("long").alias("doc_id"), F.col("vec_id").cast("int").alias("pos"), "embedding")


def _spans(spark: SparkSession, spans) -> DataFrame:
    return spark.createDataFrame([(0, *s) for s in spans], "doc_id long, span_id int, start int, end int")


def _clamped(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Ends beyond the last position are cut there, so that a span's positions are bounded by the frame."""
    n = tokens.groupBy("doc_id").agg((F.max("pos") + 1).alias("n"))
    return spans.join(n, "doc_id").withColumn("end", F.least("end", "n")).drop("n")


def _pool(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dims(pooling.pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding", DIM, method), ["label"])

    return query


def _norm(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 3))
        e = e.withColumn("u", V.normalize(F.col("embedding"), mode))
        return e.select("vec_id", r6(F.get("u", F.lit(0))).alias("v0"), r6(F.get("u", F.lit(1))).alias("v1"), r6(V.norm(F.col("u"))).alias("norm"))

    return query


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("u"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v")), "vec_id")


def _distance(metric: str):
    return lambda spark, sf_dir: _pairs(spark, sf_dir).select("vec_id", r6(V.distance(F.col("u"), F.col("v"), metric)).alias("distance"))


def _similarity(metric: str):
    return lambda spark, sf_dir: _pairs(spark, sf_dir).select("vec_id", r6(V.similarity(F.col("u"), F.col("v"), metric)).alias("similarity"))


def pool_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _frame(spark, sf_dir)
    return dims(pooling.pool_spans(t, _clamped(t, _spans(spark, SPANS)), DIM).select("span_id", "n_tokens", "embedding"), ["span_id", "n_tokens"])


def late_pool_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _frame(spark, sf_dir)
    return dims(pooling.late_pool(t, _clamped(t, _spans(spark, ODD_SPANS)), DIM), ["span_id"])


def first_two_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _frame(spark, sf_dir)
    p = pooling.pool_spans(t, _clamped(t, _spans(spark, SPANS[:2])), DIM)
    p = p.groupBy("doc_id").agg(F.max_by("embedding", -F.col("span_id")).alias("u"), F.max_by("embedding", "span_id").alias("v"))
    return p.select(*[r6(V.distance(F.col("u"), F.col("v"), m, V.SPAN_METRICS)).alias(m) for m in V.SPAN_METRICS])


_UNNEST = "SELECT {keys}, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"
_R = "round({}, 6) + 0.0"


def _pool_sql(f: str) -> str:
    return f"SELECT label, dim, {_R.format(f'{f}(x)')} AS value FROM ({_UNNEST.format(keys='label')}) GROUP BY label, dim"


def _norm_sql(mode: str) -> str:
    by = {"clamp": "greatest(n, 1e-8)", "additive": "n + 1e-8", "raw": "n"}[mode]
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings),
      d AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e)
    SELECT vec_id, {_R.format(f'v[1] / ({by})')} AS v0, {_R.format(f'v[2] / ({by})')} AS v1, {_R.format(f'n / ({by})')} AS norm FROM d"""


_PAIRS = "SELECT a.vec_id, a.embedding::DOUBLE[] AS u, b.embedding::DOUBLE[] AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_COS = "list_inner_product(u, v) / sqrt(list_inner_product(u, u) * list_inner_product(v, v))"
_CENTRED = "SELECT vec_id, list_transform(u, lambda x: x - list_avg(u)) AS u, list_transform(v, lambda x: x - list_avg(v)) AS v FROM ({})"
_L1 = "list_sum(list_transform(list_zip(u, v), lambda p: abs(p[1] - p[2])))"


def _metric_sql(expression: str, name: str, pairs: str = _PAIRS) -> str:
    return f"SELECT vec_id, {_R.format(expression)} AS {name} FROM ({pairs})"


def _values(spans) -> str:
    return "(VALUES " + ", ".join(map(str, spans)) + ") AS s(span_id, s_start, s_end)"


_SPAN_ROWS = "SELECT span_id, vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM {values} JOIN embeddings ON vec_id >= s_start AND vec_id < s_end"

QUERIES = {
    **{f"pool_{m}": _pool(m) for m in pooling.METHODS},
    **{f"norm_{m}": _norm(m) for m in V.NORM_MODES},
    **{f"dist_{m}": _distance(m) for m in V.DISTANCES},
    **{f"sim_{'dot' if m == 'dot_product' else m}": _similarity(m) for m in V.SIMILARITIES},
    "pool_spans": pool_spans,
    "late_pool_table": late_pool_table,
    "first_two_spans": first_two_spans,
}

ORACLES = {
    **{f"pool_{m}": _pool_sql(f) for m, f in (("mean", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("median", "median"))},
    **{f"norm_{m}": _norm_sql(m) for m in V.NORM_MODES},
    "dist_cosine": _metric_sql(f"1 - {_COS}", "distance"),
    "dist_euclidean": _metric_sql("sqrt(list_sum(list_transform(list_zip(u, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))", "distance"),
    "dist_manhattan": _metric_sql(_L1, "distance"),
    "sim_cosine": _metric_sql(_COS, "similarity"),
    "sim_dot": _metric_sql("list_inner_product(u, v)", "similarity"),
    "sim_pearson": _metric_sql(_COS, "similarity", _CENTRED.format(_PAIRS)),
    "sim_manhattan": _metric_sql(f"1 / (1 + {_L1})", "similarity"),
    "pool_spans": f"SELECT span_id, count(*) AS n_tokens, dim, {_R.format('avg(x)')} AS value FROM ({_SPAN_ROWS.format(values=_values(SPANS))}) GROUP BY span_id, dim",
    "late_pool_table": f"""SELECT s.span_id, d.dim, {_R.format('coalesce(p.x, 0.0)')} AS value
      FROM {_values(ODD_SPANS)} CROSS JOIN (SELECT unnest(range({DIM})) AS dim) d
      LEFT JOIN (SELECT span_id, dim, avg(x) AS x FROM ({_SPAN_ROWS.format(values=_values(ODD_SPANS))}) GROUP BY ALL) p ON p.span_id = s.span_id AND p.dim = d.dim""",
    "first_two_spans": f"""WITH m AS (SELECT span_id, dim, avg(x) AS x FROM ({_SPAN_ROWS.format(values=_values(SPANS[:2]))}) GROUP BY ALL),
      p AS (SELECT list(x ORDER BY dim) FILTER (WHERE span_id = 0) AS u, list(x ORDER BY dim) FILTER (WHERE span_id = 1) AS v FROM m),
      c AS (SELECT list_transform(u, lambda x: x - list_avg(u)) AS u, list_transform(v, lambda x: x - list_avg(v)) AS v FROM p)
    SELECT {_R.format(f'1 - {_COS}')} AS cosine, {_R.format('sqrt(list_sum(list_transform(list_zip(u, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))')} AS euclidean,
      {_R.format(_L1)} AS manhattan, {_R.format('list_inner_product(u, v)')} AS dot_product, (SELECT {_R.format(_COS)} FROM c) AS pearson FROM p""",
}
