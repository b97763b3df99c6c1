import pytest
from pyspark.sql import functions as F

from segmenta.operators import embed, structure
from segmenta.sources import io
from segmenta.streaming.micro_batches import run_in_batches


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Chapter One\nthis is the first line of the text.\n\nand more of it.")
    (tmp_path / "in" / "b.txt").write_text("")
    t = io.read_texts(spark, str(tmp_path / "in"))
    e = io.elements_of(t)
    got = e.where("metadata.filename = 'a.txt'").orderBy("pos").collect()
    assert [r["type"] for r in got] == ["Title", "NarrativeText", "NarrativeText"] and got[0]["metadata"]["file_directory"].endswith("/in")
    assert e.where("metadata.filename = 'b.txt'").count() == 0
    assert len({r["element_id"] for r in got}) == 3
    for kind in io.FORMATS:
        io.write_elements(e.drop("doc_id", "pos"), str(tmp_path / kind), kind)
    back = io.read_elements(spark, str(tmp_path / "txt"))
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in got)
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    with pytest.raises(ValueError, match="save_format"):
        io.write_elements(e, "x", "csv")
    with pytest.raises(ValueError, match="missing"):
        io.texts_from(spark.range(1))
    assert io.json_array(e, ["pos"]).count() == 1


def test_bad_lines_are_dropped(spark):
    lines = spark.createDataFrame([("{'type': 'Title', 'text': 'x', 'metadata': {'page_number': None, 'languages': ['unknown']}}",), ("",), ("not a literal (",), ("[1]",)], "value string")
    got = io.parse_elements(lines).collect()
    assert len(got) == 1 and got[0]["type"] == "Title" and got[0]["metadata"]["page_number"] is None


def test_vector_collection(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0])], "text string, embedding array<double>")
    c = io.VectorCollection(spark, str(tmp_path / "c"))
    assert c.read().count() == 0
    c.insert(rows)
    io.VectorCollection(spark, str(tmp_path / "c")).insert(rows)
    assert c.read().count() == 2
    assert io.VectorCollection(spark, str(tmp_path / "c"), delete_existing=True).read().count() == 0


def test_embedders(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x")], "doc_id long, text string")
    f = embed.token_frame(docs, embed.FunctionEmbedder(lambda: lambda tokens: [[float(len(tokens)), 1.0] for _ in tokens], 2), 3, normalize=False)
    assert [r["embedding"][0] for r in f.orderBy("doc_id", "pos").collect()] == [3, 3, 3, 2, 2, 1]
    t = embed.TableEmbedder(spark.createDataFrame([(k, [float(k)]) for k in range(9)], "pos int, embedding array<double>"), 1)
    assert [r["embedding"] for r in embed.token_frame(docs, t, normalize=False).where("doc_id = 1").orderBy("pos").collect()] == [[0.0], [1.0], [2.0], [3.0], [4.0]]
    trimmed = embed.token_frame(docs.where("doc_id = 1"), embed.HashEmbedder(2), skip_begin=1, skip_end=2)
    assert [(r["pos"], r["token"]) for r in trimmed.orderBy("pos").collect()] == [(0, "b"), (1, "c")]
    with pytest.raises(Exception, match="more tokens skipped"):
        embed.token_frame(docs, embed.HashEmbedder(2), skip_begin=2).collect()
    with pytest.raises(ValueError, match="slice"):
        embed.token_frame(docs, embed.HashEmbedder(2), 9000)
    assert embed.token_frame(docs, embed.HashEmbedder(2), special=["x"]).where("doc_id = 2").count() == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "1) a.\n2) b."), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    run_in_batches(s, structure.elements, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("type") == "ListItem").count() == 2
