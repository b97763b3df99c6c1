"""Split points: where chunks of elements begin.

Initial points, chunk scores and reports are windows and joins.  Zero repair and refinement are local searches over one
document's list of integers and run per document, with prefix sums."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.config import SplitConfig
from segmenta.operators.pooling import mean_of_positive


def top_elements(scored: DataFrame, n: int = 5, key: str = "doc_id") -> DataFrame:
    """The n elements of each document with the greatest scores, the earlier of equal ones first, with their ``rank``."""
    w = Window.partitionBy(key).orderBy(F.desc("score.sum"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def initial_splits(scored: DataFrame, config: SplitConfig | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, split_idx, score)``: the best elements, ``multiplier`` for each expected chunk."""
    c = config or SplitConfig()
    total = F.sum(F.coalesce("token_size", F.lit(0))).over(Window.partitionBy(key))
    k = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.floor(total / c.expected_tokens)) * c.multiplier))
    d = scored.withColumn("k", k).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score.sum"), "pos")))
    return d.where("rank <= k").select(key, F.col("pos").alias("split_idx"), F.col("score.sum").alias("score"))


def chunk_score(score: Column, tokens: Column, c: SplitConfig) -> Column:
    """The split element's score, scaled by how near the chunk is to the expected size; 0 outside the limits."""
    low = 0.3 + 0.7 * (1 - (c.expected_tokens - tokens) / (c.expected_tokens - c.min_tokens))
    high = 0.3 + 0.7 * (1 - (tokens - c.expected_tokens) / (c.max_tokens - c.expected_tokens))
    factor = F.when(tokens < c.expected_tokens, low).otherwise(high)
    return F.when((tokens < c.min_tokens) | (tokens > c.max_tokens), 0.0).otherwise(score * factor)


def chunk_ranges(scored: DataFrame, splits: DataFrame, config: SplitConfig | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, split_idx, end, n_tokens, score, chunk_score)``: a chunk goes from its split to the next, or to the end."""
    c = config or SplitConfig()
    w = Window.partitionBy(key).orderBy("pos")
    all_ = scored.withColumn("before", F.sum(F.coalesce("token_size", F.lit(0))).over(w) - F.coalesce("token_size", F.lit(0)))
    total = all_.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.coalesce("token_size", F.lit(0))).alias("total"))
    s = splits.select(key, F.col("split_idx").alias("pos")).join(all_, [key, "pos"]).join(total, key)
    n_tokens = F.lead("before").over(w)
    s = s.withColumn("end", F.coalesce(F.lead("pos").over(w), F.col("n"))).withColumn("n_tokens", F.coalesce(n_tokens, F.col("total")) - F.col("before"))
    return s.select(key, F.col("pos").alias("split_idx"), "end", "n_tokens", F.col("score.sum").alias("score"), chunk_score(F.col("score.sum"), F.col("n_tokens"), c).alias("chunk_score"))


def average_chunk_score(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    return ranges.groupBy(key).agg(mean_of_positive(F.col("chunk_score")).alias("avg_chunk_score"))


def split_details(scored: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with the type and the first 100 characters of the element they begin with."""
    head = scored.select(key, F.col("pos").alias("split_idx"), "type", F.substring("text", 1, 100).alias("snippet"))
    return ranges.join(head, [key, "split_idx"])


# -- local search over one document
class Document:
    """Token sizes (as prefix sums) and scores of a document's elements."""

    def __init__(self, sizes: list[int], scores: list[float], config: SplitConfig):
        self.n, self.scores, self.c = len(sizes), scores, config
        self.sums = [0]
        for s in sizes:
            self.sums.append(self.sums[-1] + s)

    def tokens(self, a: int, b: int) -> int:
        return self.sums[max(a, b)] - self.sums[a]

    def score(self, a: int, b: int) -> float:
        t, c = self.tokens(a, b), self.c
        if t < c.min_tokens or t > c.max_tokens:
            return 0.0
        if t < c.expected_tokens:
            f = 0.3 + 0.7 * (1 - (c.expected_tokens - t) / (c.expected_tokens - c.min_tokens))
        else:
            f = 0.3 + 0.7 * (1 - (t - c.expected_tokens) / (c.max_tokens - c.expected_tokens))
        return self.scores[a] * f

    def average(self, points: list[int]) -> float:
        """The mean of the positive chunk scores; the last chunk runs to the document's end."""
        got = [s for a, b in zip(points, [*points[1:], self.n], strict=True) if (s := self.score(a, b)) > 0]
        return sum(got) / len(got) if got else 0.0


def zero_repair(d: Document, initial: list[int]) -> list[int]:
    """Chunks that score zero: one that is too small joins the chunk before it (the first stays); one that is too large is cut at
    its best elements that leave a chunk near the expected size."""
    out: list[int] = []
    c = d.c
    for a, b in zip(initial, [*initial[1:], d.n], strict=True):
        out.append(a)
        if d.score(a, b) != 0:
            continue
        if d.tokens(a, b) < c.min_tokens:
            if len(out) > 1:
                out.pop()
            continue
        at = a
        while d.tokens(at, b) > c.max_tokens:
            ranked = sorted(range(at, b), key=lambda p: -d.scores[p])
            cut = next((p for p in ranked if c.expected_tokens - c.min_tokens <= d.tokens(at, p) <= c.expected_tokens + c.max_tokens and d.tokens(p, b) > 0), None)
            if cut is None:
                break
            out.append(cut)
            at = cut
    return sorted(set(out))


def refine_window(d: Document, points: list[int], start: int, end: int) -> list[int]:
    """Shift the inner points together, drop points, add midpoints, each while the average strictly improves; then halve chunks
    that are too large or score zero."""
    best, best_avg = list(points), d.average(points)
    for shift in (-1, 0, 1):
        if len(best) > 2:
            moved = sorted({best[0], best[-1], *(min(max(p + shift, start), end) for p in best[1:-1])})
            moved = [p for p in moved if p < d.n]
            if (avg := d.average(moved)) > best_avg:
                best, best_avg = moved, avg
    dropped = True
    while dropped:
        dropped, k = False, 1
        while k < len(best) - 1:
            less = best[:k] + best[k + 1 :]
            if (avg := d.average(less)) > best_avg and d.tokens(best[k - 1], best[k + 1]) <= d.c.max_tokens:
                best, best_avg, dropped = less, avg, True
            else:
                k += 1
    for k in range(1, len(best) - 1):
        if k + 1 < len(best):
            mid = (best[k] + best[k + 1]) // 2
            if mid not in best:
                more = sorted([*best, mid])
                if (avg := d.average(more)) > best_avg:
                    best, best_avg = more, avg
    added = []
    for k, p in enumerate(best):
        nxt = best[k + 1] if k + 1 < len(best) else end
        while d.tokens(p, nxt) > d.c.max_tokens or (d.score(p, nxt) == 0 and d.tokens(p, nxt) > d.c.min_tokens):
            mid = (p + nxt) // 2
            if mid <= p or mid >= nxt:
                break
            added.append(mid)
            p = mid
    return sorted({*best, *added})


def refine(d: Document, points: list[int]) -> list[int]:
    """Passes over all windows of three points, until one brings no change."""
    now = list(points)
    for _ in range(d.c.max_passes):
        p, improved, i = list(now), False, 0
        while i < len(p) - 1:
            window = p[i : i + 3]
            if len(window) < 2:
                break
            end = p[i + 2] if i + 2 < len(p) else d.n
            new = refine_window(d, window, window[0], end)
            if new != window:
                p[i : i + 3] = new
                improved = True
            i += 1
        p = sorted(set(p))
        if not improved or p == now:
            break
        now = p
    return now


def _per_document(scored: DataFrame, splits: DataFrame, search, config: SplitConfig, key: str) -> DataFrame:
    """``search(document, points)`` for each document; one small group of integers and scores each."""
    kind = scored.schema[key].dataType.simpleString()
    rows = scored.select(key, "pos", F.coalesce("token_size", F.lit(0)).cast("int").alias("size"), F.col("score.sum").cast("double").alias("score"))
    rows = rows.join(splits.select(key, F.col("split_idx").alias("pos"), F.lit(True).alias("split")), [key, "pos"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        d = Document(pdf["size"].tolist(), pdf["score"].tolist(), config)
        at = [k for k, s in enumerate(pdf["split"].tolist()) if s is True]
        found = search(d, at) if at else []
        pos = pdf["pos"].tolist()
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(found), "split_idx": [pos[k] for k in found]})

    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, split_idx int")


def repaired_splits(scored: DataFrame, splits: DataFrame, config: SplitConfig | None = None, key: str = "doc_id") -> DataFrame:
    return _per_document(scored, splits, zero_repair, config or SplitConfig(), key)


def refined_splits(scored: DataFrame, splits: DataFrame, config: SplitConfig | None = None, key: str = "doc_id") -> DataFrame:
    return _per_document(scored, splits, refine, config or SplitConfig(), key)


def split_points(scored: DataFrame, config: SplitConfig | None = None, key: str = "doc_id") -> DataFrame:
    """Initial points, repaired and refined, in one pass over each document: ``(key, split_idx)``."""
    c = config or SplitConfig()
    return _per_document(scored, initial_splits(scored, c, key), lambda d, p: refine(d, zero_repair(d, p)), c, key)
