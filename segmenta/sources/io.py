"""Readers and writers: text files, element files, vector collections."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.operators import structure

ELEMENT = (
    "type string, element_id string, text string, metadata struct<detection_class_prob:double, coordinates:struct<points:array<array<double>>>, last_modified:string, filetype:string, "
    "languages:array<string>, page_number:int, parent_id:string, file_directory:string, filename:string, element_number:int, token_size:int>, "
    "score struct<title_condition:double, token_condition:double, first_listitem_condition:double, phrases_condition:double, sum:double>"
)
FORMATS = ("txt", "json")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; below a temporary folder only where the master is local and none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="segmenta-")
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text, file_directory, filename, last_modified)``, a row for each UTF-8 file."""
    m = F.col("_metadata")
    folder = F.regexp_extract(F.regexp_replace(m["file_path"], r"^file:/*", "/"), r"^(.*)/[^/]*$", 1)
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(m["file_path"]).alias("doc_id"),
        F.col("value").alias("text"),
        F.when(folder == "", ".").otherwise(folder).alias("file_directory"),
        m["file_name"].alias("filename"),
        F.date_format(m["file_modification_time"], "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"),
    )


def texts_from(df: DataFrame) -> DataFrame:
    """Texts given as columns; all four must be there.  Empty texts give no elements; an empty directory is "."."""
    missing = {"text", "file_directory", "filename", "last_modified"} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df.withColumn("file_directory", F.when(F.coalesce("file_directory", F.lit("")) == "", ".").otherwise(F.col("file_directory")))


def elements_of(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    return structure.elements(texts, key, "text", F.col("filename"), F.col("file_directory"), F.col("last_modified"))


def parse_elements(lines: DataFrame, line: str = "value") -> DataFrame:
    """Element rows from lines that each hold a Python literal; blank lines are skipped and bad ones dropped."""
    @F.pandas_udf("string")
    def as_json(batch: pd.Series) -> pd.Series:
        import ast
        import json

        def one(x):
            try:
                value = ast.literal_eval(x.strip())
                return json.dumps(value) if isinstance(value, dict) else None
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return pd.Series([one(x) for x in batch], dtype="object")

    parsed = lines.where(F.trim(line) != "").select(F.from_json(as_json(F.col(line)), ELEMENT).alias("e"))
    return parsed.where("e is not null").select("e.*")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    return parse_elements(spark.read.text(path))


def _literal(df: DataFrame) -> DataFrame:
    """Each row as a Python literal."""
    @F.pandas_udf("string")
    def as_literal(batch: pd.Series) -> pd.Series:
        import json

        return pd.Series([repr(json.loads(x)) for x in batch], dtype="object")

    return df.select(as_literal(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"))


def write_elements(elements: DataFrame, path: str, save_format: str = "txt", mode: str = "overwrite") -> None:
    """``txt``: a Python literal a line; ``json``: JSON lines."""
    if save_format not in FORMATS:
        raise ValueError(f"save_format must be one of {FORMATS}")
    if save_format == "txt":
        _literal(elements).write.mode(mode).text(path)
    else:
        elements.write.mode(mode).json(path)


def json_array(elements: DataFrame, order: list[str], key: str = "doc_id"):
    """``(key, json)``: the elements of each document as one JSON array, in order."""
    rest = [c for c in elements.columns if c not in (key, *order)]
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("e"))))
    return elements.groupBy(key).agg(F.to_json(rows["e"], {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


class VectorCollection:
    """A collection of contents and vectors in a folder.  Opening creates it where it is missing; ``delete_existing`` empties
    it; inserts append."""

    def __init__(self, spark: SparkSession, path: str, delete_existing: bool = False):
        self.spark, self.path = spark, path
        empty = spark.createDataFrame([], "content string, vector array<float>")
        empty.write.mode("overwrite" if delete_existing else "append").parquet(path)

    def insert(self, chunks: DataFrame, content: str = "text", vector: str = "embedding") -> None:
        chunks.select(F.col(content).alias("content"), F.col(vector).cast("array<float>").alias("vector")).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema("content string, vector array<float>").parquet(self.path)
