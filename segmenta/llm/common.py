"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it: [\x20\x09-\x0D].  ``bytes.split``,
#: ``bytes.strip`` and ``bytes.lower`` use exactly this set and A-Z.
ASCII_SPACE = " \t\n\x0b\x0c\r"

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  On a cluster it must be set; only with a local master is it made where it is not (tests)."""
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="segmenta-shared-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path if "://" in path or path.startswith("file:") else "file://" + path


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/segmenta-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the application's folder in the shared one."""
    return f"{_session_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders, in whatever store they are."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove_tables(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder: to be called when no result is to be read any more."""
    remove(spark, _session_dir(spark))


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there,
    and a lost executor costs a re-read instead of a recomputation."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that ``materialise`` made and that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, path)


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes in a text column; one narrow pass, to size partitions by the data."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0]


def parts_for(size: int, per_part: int, least: int = 1) -> int:
    """Partitions of about ``per_part`` units each; in proportion to the data, without a ceiling."""
    return max(least, -(-int(size) // per_part))


def _let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often it stands in ``f``."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _times(a: Column, factor: int) -> Column:
    """a * factor modulo 2**32, for 0 <= a < 2**32, without overflow."""
    low, high = a * (factor & 0xFFFF), (a * (factor >> 16)).bitwiseAND(0xFFFF)
    return (low + F.shiftleft(high, 16)).bitwiseAND(0xFFFFFFFF)


def hashed_to(part: Column) -> Column:
    """An int that Spark's hash partitioning by one int column sends to partition ``part``, of any number above: the number whose hash
    (Murmur3 with seed 42, a bijection of 32 bits) is ``part``.  So groups numbered from 0 fill their partitions evenly."""
    inverse = lambda m: pow(m, -1, 1 << 32)
    right = F.shiftrightunsigned
    turned = lambda x, k: right(x, k).bitwiseOR(F.shiftleft(x.bitwiseAND((1 << k) - 1), 32 - k))
    steps = [
        lambda h: h.bitwiseXOR(right(h, 16)),
        lambda h: _times(h, inverse(0xC2B2AE35)),
        lambda h: h.bitwiseXOR(right(h, 13)).bitwiseXOR(right(h, 26)),
        lambda h: _times(h, inverse(0x85EBCA6B)),
        lambda h: h.bitwiseXOR(right(h, 16)).bitwiseXOR(F.lit(4).cast("long")),
        lambda h: _times((h + ((1 << 32) - 0xE6546B64)).bitwiseAND(0xFFFFFFFF), inverse(5)),
        lambda h: turned(h, 13).bitwiseXOR(F.lit(42).cast("long")),
        lambda k: _times(k, inverse(0x1B873593)),
        lambda k: turned(k, 15),
        lambda k: _times(k, inverse(0xCC9E2D51)),
        lambda k: F.when(k >= 1 << 31, k - (1 << 32)).otherwise(k),
    ]
    x = part.cast("long")
    for step in steps:
        x = _let(x, step)
    return x.cast("int")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Steps of the order in one window of a running sum.
RUN = 4096


def running_sum(df: DataFrame, value: Column, by: list[str], order: list[str], out: str, run: int = RUN) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before, of the same ``by`` and in the order of the columns ``order``, of which the
    first is a long from 0 on.  Columns of ``by`` have no nulls.

    Sums go by runs of the order first, so a window has the rows of one run, or one row for each run."""
    d = df.withColumn("__run", F.floor(F.col(order[0]) / run)).withColumn(out, value.cast("long"))
    ahead = d.groupBy(*by, "__run").agg(F.sum(out).alias("__n"))
    ahead = ahead.select(*by, "__run", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__run")) - F.col("__n")).alias("__ahead"))
    inside = F.sum(out).over(Window.partitionBy(*by, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(out)
    return d.withColumn(out, inside).join(ahead, [*by, "__run"]).withColumn(out, F.col(out) + F.col("__ahead")).select(*df.columns, out)


#: Bytes of rows that Spark hands to a Python worker at once.
ARROW_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as texts may be very long; a smaller bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; after the last one the worker gives freed memory back, as it lives on for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
