"""Semantic chunking: merged sentences, context groups, neighbour distances, chunks.

The sequential rules are folds over one document's integers, in Arrow batches; texts aren't touched by them.  A document's sentences stay
one row until they are cut into tokens or chunks, and what leaves that row is sliced before it is exploded, so work is linear in the text."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.config import SemanticConfig
from segmenta.functions import text as T
from segmenta.functions import vectors as V
from segmenta.operators import pooling

LOG = logging.getLogger("segmenta")


def traced(step: str, df: DataFrame) -> DataFrame:
    """``df``; where the logger "segmenta" is at DEBUG, its schema and plan are logged under the step's name."""
    if LOG.isEnabledFor(logging.DEBUG):
        LOG.debug("%s: %s\n%s", step, df.schema.simpleString(), df._jdf.queryExecution().toString())
    return df


def _fold(make: Callable, types: dict[str, pa.DataType], *args: Column) -> Column:
    """``array<struct>`` of the columns that ``make(lists)`` gives for each row; null for a null list."""
    names = {pa.int32(): "int", pa.float64(): "double"}

    @F.arrow_udf("array<struct<" + ",".join(f"{k}:{names[t]}" for k, t in types.items()) + ">>")
    def run(*lists: pa.Array) -> pa.Array:
        rows = [None if None in row else make(*row) for row in zip(*(x.to_pylist() for x in lists), strict=True)]
        flat = [[x[k] for row in rows for x in row or ()] for k in range(len(types))]
        items = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, types.values(), strict=True)], list(types))
        offsets = np.concatenate([[0], np.cumsum([len(row or ()) for row in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), items, mask=pa.array([row is None for row in rows]))

    return run(*args)


_RUN = {"a": pa.int32(), "b": pa.int32(), "n": pa.int32()}


def merge_runs(sizes: list[int], least: int, most: int) -> list[tuple[int, int, int]]:
    """Runs (a, b, n): sentences [a, b) with n tokens."""
    out, start, n = [], 0, 0
    for i, c in enumerate(sizes):
        if n + c > most:
            if i > start:
                out.append((start, i, n))
            start, n = i, 0
        n += c
        if n >= least:
            out.append((start, i + 1, n))
            start, n = i + 1, 0
    return out if start == len(sizes) else [*out, (start, len(sizes), n)]


def merged_spans(counts: Column, least: int, most: int) -> Column:
    """``array<struct<a, b, n>>``: runs [a, b) of sentences with n tokens.  A run ends when it has ``least`` tokens, or before a
    sentence that would take it over ``most``; what is left at the end is a run.  Counts are at most ``most``."""
    return _fold(lambda sizes: merge_runs(sizes, least, most), _RUN, counts)


def _merged(counts: Column, least: int, most: int) -> Column:
    """``merged_spans`` with ``t``, the tokens before each run."""

    def make(sizes):
        runs = merge_runs(sizes, least, most)
        before = np.cumsum([0, *(n for _, _, n in runs)]).tolist()
        return [(*r, t) for r, t in zip(runs, before[:-1], strict=True)]

    return _fold(make, _RUN | {"t": pa.int32()}, counts)


def sentence_arrays(docs: DataFrame, config: SemanticConfig | None = None, key: str = "doc_id", text: str = "text", tokenizer=None) -> DataFrame:
    """A row for each document: ``s: array<struct<sent, text, n_tokens, t_start, t_end>>``, its sentences merged to at
    least ``sentence_min`` tokens, with spans of tokens of the joined text.  No shuffle.

    No filter stands on ``s``, as it would be pushed down and have the sentences made again for each of them."""
    c = config or SemanticConfig()
    sizes = F.transform(tokenizer.all_tokens(F.col("s")), F.size) if tokenizer else F.transform("s", T.count_tokens)
    d = docs.select(key, T.limited_sentences(F.col(text), c.sentence_max, tokenizer=tokenizer).alias("s"))
    d = d.withColumn("m", _merged(sizes, c.sentence_min, c.sentence_max))
    made = F.transform("m", lambda x, i: F.struct(i.cast("int").alias("sent"), F.array_join(F.slice("s", x["a"] + 1, x["b"] - x["a"]), " ").alias("text"), x["n"].alias("n_tokens"), x["t"].alias("t_start"), (x["t"] + x["n"]).alias("t_end")))
    return traced("sentence_arrays", d.select(key, made.alias("s")))


def merged_sentences(docs: DataFrame, config: SemanticConfig | None = None, key: str = "doc_id", text: str = "text", tokenizer=None) -> DataFrame:
    """``(key, sent, text, n_tokens, t_start, t_end)``: a row for each of the sentences of ``sentence_arrays``."""
    return sentence_arrays(docs, config, key, text, tokenizer).select(key, F.inline(F.transform("s", lambda x: x)))  # not of "s" alone: that adds a filter


def sentence_lists(merged: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document: its sentences in order, ``s: array<struct<sent, text, n_tokens, t_start, t_end>>``."""
    if "s" in merged.columns:
        return merged
    return merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sent", "text", "n_tokens", "t_start", "t_end"))).alias("s"))


def group_spans(counts: Column, limit: int, overlap: int) -> Column:
    """``array<struct<a, b, n>>``: groups of sentences [a, b) of at most ``limit`` tokens before the overlap, and the n tokens that the
    next group repeats: the whole sentences at the end that fit ``overlap``."""

    def make(sizes):
        out, g, now = [], 0, 0
        for i, c in enumerate(sizes):
            if now + c > limit and i > g:
                k, n = i, 0
                while k > g and n + sizes[k - 1] <= overlap:
                    k -= 1
                    n += sizes[k]
                out.append((g, i, n))
                g, now = k, n
            now += c
        return [*out, (g, len(sizes), 0)] if sizes else out

    return _fold(make, _RUN, counts)


def _groups(merged: DataFrame, c: SemanticConfig, key: str) -> DataFrame:
    """``(key, s, g)`` with ``g: array<struct<group_id, a, b, n, t_start, t_end, own_from, own_to>>``."""
    d = sentence_lists(merged, key).withColumn("g", group_spans(F.col("s.n_tokens"), c.group_limit, c.group_overlap))
    t0, t1 = lambda x: F.get("s", x["a"])["t_start"], lambda x: F.get("s", x["b"] - 1)["t_end"]
    middle = lambda left, right: F.floor((t0(right) + t1(left) + 1) / 2).cast("int")
    last = F.size("g") - 1

    def one(x, i):
        start = F.when(i == 0, t0(x)).otherwise(middle(F.get("g", i - 1), x))
        end = F.when(i == last, t1(x)).otherwise(middle(x, F.get("g", i + 1)))
        return F.struct(i.cast("int").alias("group_id"), x["a"].alias("a"), x["b"].alias("b"), x["n"].alias("n"), t0(x).alias("t_start"), t1(x).alias("t_end"), start.alias("own_from"), end.alias("own_to"))

    return d.select(key, "s", F.transform("g", one).alias("g"))


def _sentences_of(x: Column) -> Column:
    return F.slice("s", x["a"] + 1, x["b"] - x["a"])


def context_groups(merged: DataFrame, config: SemanticConfig | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, group_id, first, last, text, overlap_next, t_start, t_end, own_from, own_to)``: what a group owns ends in the middle of an
    overlap, so every token has one owner.  ``merged``: rows of ``merged_sentences``, or ``sentence_arrays``, which needs no shuffle."""
    rows = F.transform("g", lambda x: F.struct(x["group_id"].alias("group_id"), x["a"].alias("first"), (x["b"] - 1).alias("last"), F.array_join(_sentences_of(x)["text"], " ").alias("text"), x["n"].alias("overlap_next"), *[x[k].alias(k) for k in ("t_start", "t_end", "own_from", "own_to")]))
    names = ["group_id", "first", "last", "text", "overlap_next", "t_start", "t_end", "own_from", "own_to"]
    d = _groups(merged, config or SemanticConfig(), key).select(key, F.explode(rows).alias("x"))
    return traced("context_groups", d.select(key, *[F.col("x")[k].alias(k) for k in names]))


def group_token_frame(merged: DataFrame, embedder, config: SemanticConfig | None = None, key: str = "doc_id", normalize: bool = False, tokenizer=None) -> DataFrame:
    """``(key, group_id, sent, pos, token, text, embedding)``: tokens of the sentences, embedded group by group (a slice is a
    group) and taken from the group that owns them; ``normalize``: as unit vectors (clamped).  A sentence's text is on its first token."""
    cut = tokenizer.tokens if tokenizer else T.token_texts
    rows = F.transform("g", lambda x: F.struct(x["group_id"].alias("group_id"), x["own_from"].alias("own_from"), x["own_to"].alias("own_to"), _sentences_of(x).alias("sentences")))
    d = _groups(merged, config or SemanticConfig(), key).select(key, F.explode(rows).alias("x")).select(key, "x.*")
    d = d.select(key, "group_id", "own_from", "own_to", F.explode("sentences").alias("x"))
    d = d.select(key, "group_id", "own_from", "own_to", F.col("x.sent").alias("sent"), F.col("x.t_start").alias("t_start"), F.col("x.text").alias("whole"))
    # a token's text goes with the first token alone, cut out before the explosion
    tokens = F.transform(cut(F.col("whole")), lambda t, j: F.struct((F.col("t_start") + j).cast("int").alias("pos"), t.alias("token"), F.when(j == 0, F.col("whole")).alias("text")))
    t = d.select(key, "group_id", "own_from", "own_to", "sent", F.explode(tokens).alias("x")).select(key, "group_id", "own_from", "own_to", "sent", "x.*")
    t = embedder.embed(t, [key, "group_id"]).where("pos >= own_from and pos < own_to")
    e = V.normalize(F.col("embedding"), "clamp") if normalize else F.col("embedding")
    return traced("group_token_frame", t.select(key, "group_id", "sent", "pos", "token", "text", e.alias("embedding")))


_SIDES = ("own", "current", "previous", "next")


def _frames(w, c: SemanticConfig) -> dict:
    """The sentences of each side, as frames about a sentence."""
    k, size = c.num_neighbors, c.current_chunk_size
    return {"own": w.rowsBetween(0, 0), "current": w.rowsBetween(0, size - 1), "previous": w.rowsBetween(-k, -1), "next": w.rowsBetween(size, size + k - 1)}


_PARTIAL = {"mean": (F.sum, F.sum), "sum": (F.sum, F.sum), "max": (F.max, F.max), "min": (F.min, F.min)}


#: What is a multiple of this is added up without rounding, below 2**27 in all.
_STEP = 2.0**-26


def _in_any_order(x: Column) -> Column:
    """The sum of ``x``, the same whatever the order of rows: multiples of a step and what is left are added up apart."""
    small = F.abs(x) < 1 / _STEP
    whole = F.when(small, F.rint(x / _STEP) * _STEP).otherwise(x)
    return F.sum(whole) + F.sum(F.when(small, x - whole).otherwise(0.0))


def _sides_by_frames(tokens: DataFrame, dim: int, c: SemanticConfig, key: str) -> DataFrame:
    """``(key, sent, current_text, n_tokens, own, current, previous, next)`` from a frame of ``group_token_frame``: each sentence's tokens are
    added up once, and the sides are frames over these sums."""
    first, again = _PARTIAL[c.pooling]
    w = Window.partitionBy(key).orderBy("sent")
    frames = _frames(w, c)
    count = F.count(F.lit(1)).alias("n_tokens")
    joined = F.array_join(F.collect_list("text").over(frames["current"]), " ").alias("current_text")
    if dim <= pooling.WIDE:
        x = lambda d: F.get("embedding", F.lit(d)).cast("double")
        by = tokens.groupBy(key, "sent").agg(count, F.max("text").alias("text"), *[(_in_any_order if first is F.sum else first)(x(d)).alias(f"_{d}") for d in range(dim)])

        def side(over, name):
            # a cosine is the same of sums as of means, and sums are not rounded by a division
            n = F.sum("n_tokens").over(over) if c.pooling == "mean" and (name == "own" or c.metric != "cosine") else F.lit(1)
            return F.when(F.count(F.lit(1)).over(over) > 0, F.array(*[again(f"_{d}").over(over) / n for d in range(dim)]))

        return by.select(key, "sent", joined, F.col("n_tokens").cast("int").alias("n_tokens"), *[side(over, name).alias(name) for name, over in frames.items()])
    texts = tokens.groupBy(key, "sent").agg(count, F.max("text").alias("text")).select(key, "sent", joined, F.col("n_tokens").cast("int").alias("n_tokens"))
    long = tokens.select(key, "sent", F.posexplode("embedding").alias("d", "x")).groupBy(key, "sent", "d").agg(first(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    own = _frames(Window.partitionBy(key, "d").orderBy("sent"), c)
    long = long.select(key, "sent", "d", *[(again("x").over(o) / (F.sum("n").over(o) if c.pooling == "mean" else F.lit(1))).alias(name) for name, o in own.items()])
    all_ = F.array_sort(F.collect_list(F.struct("d", *_SIDES)))
    by = long.groupBy(key, "sent").agg(all_.alias("all")).select(key, "sent", *[F.when(F.get(F.col("all")[s], F.lit(0)).isNotNull(), F.col("all")[s]).alias(s) for s in _SIDES])
    return texts.join(by, [key, "sent"])


def _sides_by_spans(merged: DataFrame, tokens: DataFrame, dim: int, c: SemanticConfig, key: str) -> DataFrame:
    """The same for any token frame and any pooling: spans of each side, pooled over all their tokens."""
    k, size = c.num_neighbors, c.current_chunk_size
    d = sentence_lists(merged, key)
    n = F.size("s")

    def sides(x, i):
        span = lambda name, a, b: F.struct(F.lit(name).alias("side"), F.get("s", a)["t_start"].alias("start"), F.get("s", b - 1)["t_end"].alias("end"))
        end = F.least(n, i + size)
        all_ = F.array(span("own", i, i + 1), span("current", i, end), F.when(i > 0, span("previous", F.greatest(F.lit(0), i - k), i)), F.when(i + size < n, span("next", i + size, F.least(n, i + size + k))))
        return F.struct(i.cast("int").alias("sent"), F.array_join(F.slice("s", i + 1, end - i)["text"], " ").alias("current_text"), x["n_tokens"].alias("n_tokens"), F.filter(all_, lambda y: y.isNotNull()).alias("sides"))

    d = d.select(key, F.inline(F.transform("s", sides)))
    spans = d.select(key, "sent", F.explode("sides").alias("x")).select(key, "sent", "x.*")
    pooled = pooling.pool_spans(tokens, spans, dim, c.pooling, key, ["sent", "side"])
    by = pooled.groupBy(key, "sent").agg(*[F.max(F.when(F.col("side") == s, F.col("embedding"))).alias(s) for s in _SIDES])
    return d.drop("sides").join(by, [key, "sent"])


def sentence_distances(merged: DataFrame, tokens: DataFrame, dim: int, config: SemanticConfig | None = None, key: str = "doc_id", digits: int = 9) -> DataFrame:
    """A row for each sentence: ``prev_distance`` from the k sentences before to the current ones, ``next_distance`` from these to the k
    after, null where there are none; their ``ratio``; and the sentence's own vector.  Sides are pooled over all their tokens.

    Frames of ``group_token_frame`` are summed by sentence; others, and medians, go by spans of tokens.
    Distances are rounded to ``digits`` decimals: between equal sides they are rounding noise, whose ratio means nothing."""
    c = config or SemanticConfig()
    framed = c.pooling in _PARTIAL and {"sent", "text"} <= set(tokens.columns)
    by = _sides_by_frames(tokens, dim, c, key) if framed else _sides_by_spans(merged, tokens, dim, c, key)
    between = V.cosine_distance_once if c.metric == "cosine" else lambda u, v: V.distance(u, v, c.metric, V.SPAN_METRICS)
    metric = lambda u, v: F.when(u.isNotNull() & v.isNotNull(), V.rounded(between(u, v), digits) + F.lit(0.0))
    by = by.withColumn("prev_distance", metric(F.col("previous"), F.col("current"))).withColumn("next_distance", metric(F.col("current"), F.col("next")))
    by = by.withColumn("ratio", V.ratio(F.col("prev_distance"), F.col("next_distance")))
    return traced("sentence_distances", by.select(key, "sent", "current_text", "n_tokens", "prev_distance", "next_distance", "ratio", F.col("own").alias("embedding")))


def chunk_spans(items: Column, c: SemanticConfig) -> Column:
    """``array<struct<a, b, start_ratio>>`` from ``array<struct<t, r>>``: chunks of sentences a to b, both in.  A sentence is
    taken in first; then a large ratio, or enough tokens with a middling ratio or too many tokens, ends the chunk, and the next
    begins with this sentence again (or after it).  NaN is in no order with a threshold."""

    def make(tokens, ratios):
        out, a, total, start = [], 0, 0, None
        for i, (t, r) in enumerate(zip(tokens, ratios, strict=True)):
            total += t
            hard, middling = r is not None and r >= c.hard_ratio, r is not None and r > c.min_ratio
            if hard or (total >= c.soft_min_tokens and (total >= c.max_tokens or middling)):
                out.append((a, i, start))
                a, total, start = (i, t, r) if c.repeat_boundary else (i + 1, 0, r)
        return [*out, (a, len(tokens) - 1, start)] if a < len(tokens) else out

    types = {"a": pa.int32(), "b": pa.int32(), "start_ratio": pa.float64()}
    return _fold(make, types, F.transform(items, lambda x: x["t"].cast("long")), F.transform(items, lambda x: x["r"].cast("double")))


def format_ratio(r: Column) -> Column:
    """Four decimals of the binary value, ties to even as ``printf`` has them (Java's format rounds its decimal digits up); "inf", "nan", and "N/A" for null."""

    @F.arrow_udf("string")
    def four(x: pa.Array) -> pa.Array:
        return pa.array(["N/A" if v is None else f"{v:.4f}" for v in x.to_pylist()], pa.string())

    return four(r)


def semantic_chunks(distances: DataFrame, dim: int, config: SemanticConfig | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, chunk_id, first, last, text, start_ratio, embedding)``; a chunk's vector is the pool of its sentences' vectors."""
    c = config or SemanticConfig()
    d = distances.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sent", "current_text", "n_tokens", "ratio", "embedding"))).alias("s"))
    d = d.withColumn("c", chunk_spans(F.transform("s", lambda x: F.struct(x["n_tokens"].alias("t"), x["ratio"].alias("r"))), c))

    def one(x, i):
        own = F.slice("s", x["a"] + 1, x["b"] - x["a"] + 1)
        return F.struct(i.cast("int").alias("chunk_id"), x["a"].alias("first"), x["b"].alias("last"), F.array_join(own["current_text"], " ").alias("text"), x["start_ratio"].alias("r"), own["embedding"].alias("v"))

    d = d.select(key, F.inline(F.transform("c", one)))
    out = d.select(key, "chunk_id", "first", "last", "text", format_ratio(F.col("r")).alias("start_ratio"), "v")
    if c.pooling != "median":
        return out.withColumn("embedding", pooling.pool_array(F.col("v"), c.pooling)).drop("v")
    vectors = pooling.pool(out.select(key, "chunk_id", F.explode("v").alias("v")), [key, "chunk_id"], "v", dim, c.pooling)
    return out.drop("v").join(vectors, [key, "chunk_id"])


def late_chunks(docs: DataFrame, embedder, dim: int, slice_tokens: int = 4000, method: str = "mean", key: str = "doc_id", text: str = "text", tokenizer=None) -> DataFrame:
    """Late chunking of whole texts: ``(key, sent, n_tokens, embedding)`` for every sentence of the text, pooled over vectors of its tokens that
    were embedded in slices of the joined text.  The text is tokenized once, sentence by sentence, so no spans need to be looked up; chunks
    that come from elsewhere go through ``spans.char_spans``, ``spans.token_spans`` and ``pooling.late_pool``.  Two shuffles."""
    found = T.sentences(F.col(text))
    found = tokenizer.all_tokens(found) if tokenizer else F.transform(found, T.token_texts)
    rows = F.flatten(F.transform(found, lambda tokens, i: F.transform(tokens, lambda t: F.struct(i.alias("sent"), t.alias("token")))))
    t = docs.select(key, F.posexplode(rows).alias("pos", "x")).select(key, "pos", "x.sent", "x.token")
    t = embedder.embed(t.withColumn("slice", F.floor(F.col("pos") / slice_tokens)), [key, "slice"])
    return pooling.pool(t, [key, "sent"], "embedding", dim, method, extra={"n_tokens": F.count(F.lit(1))})
