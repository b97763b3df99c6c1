import pytest
from pyspark.sql import functions as F

from segmenta.llm import common


@pytest.mark.parametrize("parts", [1, 7, 51, 1000])
def test_groups_are_hashed_to_their_partitions(spark, parts):
    d = spark.range(parts).withColumn("g", common.hashed_to(F.col("id")))
    assert d.where(F.hash("g") != F.col("id")).count() == 0
    got = d.repartition(parts, "g").withColumn("p", F.spark_partition_id())
    assert got.where("p <> id").count() == 0


def test_running_sum(spark):
    rows = [(s, k, (k * 7) % 5) for s in ("a", "b") for k in range(50) if k % 3]
    d = spark.createDataFrame(rows, "s string, k long, v long")
    got = {(r["s"], r["k"]): r["before"] for r in common.running_sum(d, F.col("v"), ["s"], ["k"], "before", run=8).collect()}
    assert got == {(s, k): sum(v for t, j, v in rows if t == s and j < k) for s, k, _ in rows}
    whole = {(r["s"], r["k"]): r["before"] for r in common.running_sum(d, F.col("v"), [], ["k", "s"], "before", run=8).collect()}
    assert whole == {(s, k): sum(v for t, j, v in rows if (j, t) < (k, s)) for s, k, _ in rows}
    assert common.running_sum(d.where("false"), F.col("v"), ["s"], ["k"], "before").count() == 0


def test_tables_are_removed(spark):
    t = common.materialise(spark.range(5).toDF("x"), "some")
    assert t.count() == 5
    common.dropped(t)
    common.dropped(common.materialise(spark.range(0).toDF("x"), "none"))
    folder = t.inputFiles()[0].rsplit("/", 1)[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
