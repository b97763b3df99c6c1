"""Token rows, token windows, and who owns a token where windows overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.config import WindowConfig
from segmenta.functions import text as T


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pos, token, c_start, c_end)``: the text is cut into gaps and tokens, and a running sum of lengths places
    them.  One shuffle, on the key."""
    pieces = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(T.PIECE), F.lit(0))).alias("i", "token"))
    w = Window.partitionBy(key).orderBy("i")
    placed = pieces.withColumn("c_end", F.sum(F.length("token")).over(w)).withColumn("gap", F.col("token").rlike(r"(?U)^\s"))
    placed = placed.withColumn("pos", F.sum(F.when(F.col("gap"), 0).otherwise(1)).over(w) - 1)
    return placed.where(~F.col("gap")).select(key, F.col("pos").cast("int").alias("pos"), "token", (F.col("c_end") - F.length("token")).cast("int").alias("c_start"), F.col("c_end").cast("int").alias("c_end"))


def without_special(tokens: DataFrame, special: list[str], key: str = "doc_id") -> DataFrame:
    """Tokens other than the special ones, numbered anew; a document of special tokens alone has no rows."""
    w = Window.partitionBy(key).orderBy("pos")
    return tokens.where(~F.col("token").isin(special)).withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def _window(k: Column, n: Column, config: WindowConfig) -> Column:
    """Window ``k`` over ``n`` tokens, ``struct<win_id, start, end, own_from, own_to>``."""
    size, step = config.max_tokens, config.max_tokens - config.overlap_tokens
    start = lambda j: j * step
    end = lambda j: F.least(j * step + size, n)
    border = lambda j: F.when(j == 0, 0).when(j >= _count(n, config), n).otherwise(F.floor((start(j) + end(j - 1) + 1) / 2)).cast("int")
    return F.struct(k.cast("int").alias("win_id"), start(k).cast("int").alias("start"), end(k).cast("int").alias("end"), border(k).alias("own_from"), border(k + 1).alias("own_to"))


def _count(n: Column, config: WindowConfig) -> Column:
    return F.when(n <= config.max_tokens, 1).otherwise(F.ceil(n / (config.max_tokens - config.overlap_tokens)).cast("int"))


def windows(n: Column, config: WindowConfig) -> Column:
    """``array<struct<win_id, start, end, own_from, own_to>>`` over ``n`` tokens.

    Windows begin every ``max - overlap`` tokens, so the last may lie inside the one before.  Where two windows overlap the
    earlier one owns up to the middle of the overlap (the odd token is its own), so every token has one owner."""
    made = F.transform(F.sequence(F.lit(0), _count(n, config) - 1), lambda k: _window(k, n, config))
    return F.when(n > 0, made).otherwise(F.filter(made, lambda x: F.lit(False)))


def window_rows(docs: DataFrame, config: WindowConfig, key: str = "doc_id", text: str = "text", tokenizer=None) -> DataFrame:
    """A row for each window: its span, what it owns, its tokens and its text, which is the slice of the source."""
    cut = tokenizer.tokens if tokenizer else T.token_texts
    d = docs.select(key, F.col(text).alias("text"), cut(F.col(text)).alias("tokens"))
    d = d.select(key, "tokens", F.explode(windows(F.size("tokens"), config)).alias("w"))
    return d.select(key, "w.*", F.slice("tokens", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("tokens"))


def owned(tokens: DataFrame, config: WindowConfig, key: str = "doc_id") -> DataFrame:
    """Each token row once for every window that holds it: with ``win_id``, its place ``j`` in it, and whether the window owns it.

    A token's windows follow from its position and the number of tokens, so nothing is joined."""
    size, step = config.max_tokens, config.max_tokens - config.overlap_tokens
    n, pos = F.col("__n"), F.col("pos")
    first = F.greatest(F.floor((pos - size) / step).cast("int") + 1, F.lit(0))
    last = F.least(F.floor(pos / step).cast("int"), _count(n, config) - 1)
    t = tokens.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)).cast("int"))
    t = t.withColumn("w", F.explode(F.transform(F.sequence(first, last), lambda k: _window(k, n, config))))
    return t.select(*tokens.columns, F.col("w.win_id").alias("win_id"), (pos - F.col("w.start")).alias("j"), ((pos >= F.col("w.own_from")) & (pos < F.col("w.own_to"))).alias("owned"))


def exact_overlap(earlier: Column, later: Column) -> Column:
    """The greatest n for which the last n tokens of ``earlier`` are the first n of ``later``."""
    most = F.least(F.size(earlier), F.size(later))
    fits = F.filter(F.sequence(F.lit(0), most), lambda n: (n == 0) | (F.slice(earlier, F.size(earlier) - n + 1, n) == F.slice(later, F.lit(1), n)))
    return F.array_max(fits)


def _ratio_of_tokens(a: str, b: str, known: dict) -> float:
    from difflib import SequenceMatcher

    if (a, b) not in known:
        known[a, b] = SequenceMatcher(None, a, b).ratio()
    return known[a, b]


def fuzzy_overlap(pairs: DataFrame, earlier: str, later: str, threshold: float = 0.7, out: str = "overlap") -> DataFrame:
    """``pairs`` with the greatest n for which the last n tokens of ``earlier`` and the first n of ``later`` all have a similarity
    ratio of at least ``threshold``, one by one."""
    @F.pandas_udf("int")
    def longest(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}

        def one(x, y) -> int:
            for n in range(min(len(x), len(y)), 0, -1):
                if all(_ratio_of_tokens(p, q, known) >= threshold for p, q in zip(x[len(x) - n :], y[:n], strict=True)):
                    return n
            return 0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    return pairs.withColumn(out, longest(F.col(earlier), F.col(later)))
