"""Token vectors: pluggable embedders, slices that are embedded together, short and long texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.config import WindowConfig
from segmenta.functions import text as X
from segmenta.functions import vectors as V
from segmenta.functions.hashing import hash_vector
from segmenta.operators import tokens as K


class Tokenizer(Protocol):
    """Cuts texts into tokens: ``rows`` as ``(key, pos, token, c_start, c_end)``; ``tokens`` of a text and ``all_tokens`` of an array of texts as
    columns, and ``limited``, an array of texts with those of more than ``limit`` tokens cut into slices.  Sentence limits, merging, groups
    and late chunking go through these.  ``ids`` and ``decode`` go to the vocabulary's numbers and back."""

    def rows(self, docs: DataFrame, key: str, text: str) -> DataFrame: ...

    def tokens(self, text: Column) -> Column: ...

    def all_tokens(self, texts: Column) -> Column: ...

    def limited(self, texts: Column, limit: int) -> Column: ...

    def ids(self, text: Column) -> Column: ...

    def decode(self, ids: Column) -> Column: ...


class Embedder(Protocol):
    """Adds ``embedding`` to token rows; tokens of one ``slice_cols`` group see each other, others don't."""

    dim: int

    def embed(self, tokens: DataFrame, slice_cols: list[str]) -> DataFrame: ...


class TextEmbedder(Protocol):
    """Vectors of whole texts."""

    dim: int

    def embed_texts(self, docs: DataFrame, text: str, out: str) -> DataFrame: ...


class WordTokenizer:
    """The native default: words and single other characters.  With a vocabulary, ids are places in it (from 0, -1 for other tokens), and
    decoding joins tokens by spaces without those of ``special``."""

    def __init__(self, vocabulary: list[str] | None = None, special: list[str] | None = None):
        self.vocabulary, self.special = vocabulary or [], special or []

    def rows(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        return K.token_rows(docs, key, text)

    def tokens(self, text: Column) -> Column:
        return X.token_texts(text)

    def all_tokens(self, texts: Column) -> Column:
        return F.transform(texts, X.token_texts)

    def limited(self, texts: Column, limit: int) -> Column:
        return F.flatten(F.transform(texts, lambda s: X.split_long(s, limit)))

    def ids(self, text: Column) -> Column:
        words = F.array(*[F.lit(w) for w in self.vocabulary]).cast("array<string>")
        return F.transform(self.tokens(text), lambda t: (F.array_position(words, t) - 1).cast("int"))

    def decode(self, ids: Column) -> Column:
        words = F.array(*[F.lit(w) for w in self.vocabulary]).cast("array<string>")
        found = F.transform(ids, lambda i: F.when(i >= 0, F.get(words, i)))
        return F.array_join(F.filter(found, lambda t: t.isNotNull() & ~t.isin(*self.special, "")), " ")


class FunctionTokenizer:
    """Any tokenizer, in Arrow batches.  ``load()`` runs once in a task and returns an object with ``encode(text)``, a list of
    ``(token, start, end, id)`` in order, and ``decode(ids)``, a text.  Null texts give null."""

    _TOKEN = pa.list_(pa.struct([("token", pa.string()), ("c_start", pa.int32()), ("c_end", pa.int32()), ("id", pa.int32())]))

    def __init__(self, load):
        self.load = load

    def _apply(self, kind: str, arrow: pa.DataType, make, column: Column) -> Column:
        """``make(model, value)`` of every value that isn't null."""
        load = self.load

        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()
            for batch in batches:
                yield pa.array([None if x is None else make(model, x) for x in batch.to_pylist()], arrow)

        return run(column)

    def _encoded(self, text: Column) -> Column:
        names = ("token", "c_start", "c_end", "id")
        return self._apply("array<struct<token:string,c_start:int,c_end:int,id:int>>", self._TOKEN, lambda m, x: [dict(zip(names, t, strict=True)) for t in m.encode(x)], text)

    def rows(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        return docs.select(key, F.posexplode(self._encoded(F.col(text))).alias("pos", "t")).select(key, "pos", "t.token", "t.c_start", "t.c_end")

    def tokens(self, text: Column) -> Column:
        return self._encoded(text)["token"]

    def all_tokens(self, texts: Column) -> Column:
        return self._apply("array<array<string>>", pa.list_(pa.list_(pa.string())), lambda m, all_: [[t[0] for t in m.encode(x)] for x in all_], texts)

    def limited(self, texts: Column, limit: int) -> Column:
        def cut(model, all_):
            out = []
            for x in all_:
                t = model.encode(x)
                out.extend([x] if len(t) <= limit else [x[t[k][1] : t[min(k + limit, len(t)) - 1][2]] for k in range(0, len(t), limit)])
            return out

        return self._apply("array<string>", pa.list_(pa.string()), cut, texts)

    def ids(self, text: Column) -> Column:
        return self._encoded(text)["id"]

    def decode(self, ids: Column) -> Column:
        return self._apply("string", pa.string(), lambda m, x: m.decode(x), ids)


class HashEmbedder:
    """A deterministic stand-in for a model: a hash vector of the token, and ``context`` of the mean over its slice.  The mixing is
    ours: it lets slices, windows and pooling order show in the results without a model."""

    def __init__(self, dim: int = 4, context: float = 0.25):
        self.dim, self.context = dim, context

    def embed(self, tokens: DataFrame, slice_cols: list[str]) -> DataFrame:
        w = Window.partitionBy(*slice_cols)
        made = tokens.withColumn("e", hash_vector(F.col("token"), self.dim))
        mixed = [(1 - self.context) * F.get("e", F.lit(d)) + self.context * F.avg(F.get("e", F.lit(d))).over(w) for d in range(self.dim)]
        return made.withColumn("embedding", F.array(*mixed)).drop("e")


class FunctionEmbedder:
    """A model behind a function from token lists (one for each slice) to lists of vectors.  It is loaded once by each
    worker; a slice is one call, and bounded by the slice size."""

    def __init__(self, load, dim: int):
        self.load, self.dim = load, dim

    def embed(self, tokens: DataFrame, slice_cols: list[str]) -> DataFrame:
        load, cols = self.load, tokens.columns
        rows = tokens.groupBy(*slice_cols).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in cols if c not in (*slice_cols, "pos")]))).alias("rows"))

        def run(batches):
            model = load()
            for pdf in batches:
                pdf["vectors"] = [[[float(x) for x in v] for v in model([r["token"] for r in rows])] for rows in pdf["rows"]]
                yield pdf

        schema = T.StructType([*rows.schema.fields, T.StructField("vectors", T.ArrayType(T.ArrayType(T.DoubleType())))])
        out = rows.mapInPandas(run, schema).select(*slice_cols, F.explode(F.arrays_zip("rows", "vectors")).alias("z"))
        return out.select(*[F.col(c) if c in slice_cols else F.col(f"z.rows.{c}").alias(c) for c in cols], F.col("z.vectors").alias("embedding"))


class HashTextEmbedder:
    """A deterministic stand-in for a service that embeds whole texts: the hash vector of the text, as a unit vector (additive)."""

    def __init__(self, dim: int = 4):
        self.dim = dim

    def embed_texts(self, docs: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        return docs.withColumn(out, V.normalize(hash_vector(F.col(text), self.dim), "additive"))


class FunctionTextEmbedder:
    """A model or service for whole texts, in Arrow batches: ``load()`` runs once in a task and returns ``model(texts) -> vectors``, which is
    called with at most ``batch`` texts.  A null text has no vector."""

    def __init__(self, load, dim: int, batch: int = 64):
        self.load, self.dim, self.batch = load, dim, batch

    def embed_texts(self, docs: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        load, size = self.load, self.batch

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                known, vectors = [x for x in texts if x is not None], []
                for at in range(0, len(known), size):
                    vectors.extend([float(y) for y in v] for v in model(known[at : at + size]))
                made = iter(vectors)
                yield pd.Series([None if x is None else next(made) for x in texts], dtype="object")

        return docs.withColumn(out, run(F.col(text)))


class TableEmbedder:
    """Vectors from a table ``(pos, embedding)``, the same for every document."""

    def __init__(self, table: DataFrame, dim: int):
        self.table, self.dim = table, dim

    def embed(self, tokens: DataFrame, slice_cols: list[str]) -> DataFrame:
        return tokens.join(self.table.select("pos", "embedding"), "pos")


def trimmed(tokens: DataFrame, skip_begin: int = 0, skip_end: int = 0, key: str = "doc_id") -> DataFrame:
    """Without the first and last tokens of each text; skipping more tokens than there are is an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    checked = F.when(n < skip_begin + skip_end, F.raise_error(F.lit("more tokens skipped than there are")).cast("int")).otherwise(F.col("pos"))
    t = tokens.withColumn("pos", checked).withColumn("n", n).where((F.col("pos") >= skip_begin) & (F.col("pos") < F.col("n") - skip_end))
    return t.withColumn("pos", (F.col("pos") - skip_begin).cast("int")).drop("n")


def token_embeddings(tokens: DataFrame, embedder: Embedder, slice_tokens: int = 4000, skip_begin: int = 0, skip_end: int = 0, key: str = "doc_id") -> DataFrame:
    """Vectors of each text's tokens, in slices that are embedded alone; trimmed after that."""
    WindowConfig(slice_tokens=slice_tokens)
    made = embedder.embed(tokens.withColumn("slice", F.floor(F.col("pos") / slice_tokens)), [key, "slice"]).drop("slice")
    return trimmed(made, skip_begin, skip_end, key) if skip_begin or skip_end else made


def token_frame(docs: DataFrame, embedder: Embedder, slice_tokens: int = 4096, special: list[str] | None = None, normalize: bool = True, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer | None = None, **skips) -> DataFrame:
    """Short texts: ``(key, pos, token, embedding)``, one slice after the other, special tokens out, unit vectors (raw)."""
    t = token_embeddings((tokenizer or WordTokenizer()).rows(docs, key, text), embedder, slice_tokens, key=key, **skips)
    t = K.without_special(t, special, key) if special else t
    return t.withColumn("embedding", _unit("raw")) if normalize else t


def _unit(mode: str) -> Column:
    return V.normalize(F.col("embedding"), mode)


def long_token_frame(docs: DataFrame, embedder: Embedder, config: WindowConfig | None = None, special: list[str] | None = None, normalize: bool = True, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """Long texts: tokens are embedded in every window (and slice) that holds them, and taken from the window that owns
    them; special tokens out, unit vectors (additive)."""
    config = config or WindowConfig(512, 50, 128)
    t = K.owned((tokenizer or WordTokenizer()).rows(docs, key, text), config, key).withColumn("slice", F.floor(F.col("j") / config.slice_tokens))
    t = embedder.embed(t, [key, "win_id", "slice"]).where("owned").drop("win_id", "slice", "j", "owned")
    t = K.without_special(t, special, key) if special else t
    return t.withColumn("embedding", _unit("additive")) if normalize else t
