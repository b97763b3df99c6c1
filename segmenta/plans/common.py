"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Rounded to six decimals, as summation order differs between engines; adding zero drops a negative zero's sign."""
    return F.round(c, 6) + F.lit(0.0)


def dims(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """A row for each component of a vector."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).select(*keys, F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("value"))
