"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which the next one gets as
its ``docs``.  All but the last return the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmenta.llm import bpe, langid, linededup, mixing, simhash
from segmenta.llm.common import fresh_path, read_table

#: Least share of a text's n-grams that its language must hold (after the correction for false positives).
MIN_LANGUAGE_SCORE = 0.25


def own_names(docs: DataFrame, n: int) -> tuple[str, ...]:
    """Names that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return tuple([name for k in range(len(taken) + n) if (name := f"stage_{k}") not in taken][:n])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts of which no language holds enough n-grams, go; ``lang`` becomes the prediction.

    Null and empty texts go; rows with a null id or language are kept as others, and repeated rows as often as they come; other columns pass, whatever their names."""
    pred, score = own_names(docs, 2)
    found = langid.predict(docs, langid.fit(docs.where(~langid.held_out())), pred=pred, score=score)
    kept = found.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col(pred)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; documents stay, and ``n_chars`` is counted anew.

    Every row stays, null and empty texts as they are (``n_chars`` of a null text is null); repeated rows are documents of their own; other columns pass."""
    kept = linededup.drop_frequent_lines(docs, out="text", counts=own_names(docs, 2))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest id, a null one last; of documents with one id
    that with the smallest hash of its text; of copies under one id the first by the other columns, so that one row stays of each group."""
    place_, copy_ = own_names(docs, 2)
    is_null = F.col("doc_id").isNull()
    place = F.struct(is_null.alias("is_null"), F.when(is_null, F.lit(0)).otherwise(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("h"))
    placed = docs.withColumn(place_, place)
    groups = simhash.near_duplicates(placed, key=place_)
    first = groups.where(F.col(place_) == F.col("component_id")).select(place_).distinct()
    copies = Window.partitionBy(place_).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")])
    kept = placed.join(first, place_, "left_semi").withColumn(copy_, F.row_number().over(copies))
    return kept.where(F.col(copy_) == 1).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that it takes, whole or in part.

    A null source is a source; null and empty texts have no words to take and no row; other columns pass with each copy."""
    base, _, reads = mixing.mix(docs)
    mixed = mixing.mixed_documents(docs, base, reads)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of ids and decoded text: a row for each row, null texts as empty ones."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.round_trip(docs, path))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
]

#: None: the stages' learned filters, fingerprints, permutations and tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
