"""The queries of the training-data operators and their SQL.

Every query is thin: it applies one operator, with production parameters, to the whole
of its table and derives the contract's digest columns from the operator's real output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from segmenta.llm import bpe, covertree, langid, licenses, linededup, lm, mixing, simhash, tokenstore, webp
from segmenta.llm.common import read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.round_trip(read_table(spark, sf_dir, "documents"), path))


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(read_table(spark, sf_dir, "documents")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, read_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(webp.decode_media(webp.encode_media(read_table(spark, sf_dir, "documents"))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base, plan, reads = mixing.mix(docs)
    return mixing.counted(base, plan, mixing.mixed_blocks(docs, base, reads)).drop("source").withColumnRenamed("key", "doc_id")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.digests(linededup.drop_frequent_lines(docs))


def op9_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenstore.digests(tokenstore.read_store(spark, tokenstore.write_store(read_table(spark, sf_dir, "documents"), path, end_id=2)))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_covertree": op2_covertree,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_langid": op5_langid,
    "op6_media": op6_media,
    "op7_mixing": op7_mixing,
    "op8_linededup": op8_linededup,
    "op9_tokenstore": op9_tokenstore,
    "op10_lm": op10_lm,
}

ORACLES: dict[str, str] = {
    "op8_linededup": linededup.oracle_sql(),
}
