import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from segmenta.llm import bpe, langid, linededup, simhash


def test_stages(spark, small, tmp_path):
    docs, kept = small, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
        if name != "bpe":
            assert docs.columns == small.columns
    before, after = kept["language_id"]
    assert before.where(F.col("text").rlike("(?U)[A-Za-z]{20}")).join(after, "doc_id", "left_anti").count() == 0
    assert after.where(F.col("lang") == langid.UNKNOWN).count() == 0
    before, after = kept["line_dedup"]
    assert after.count() == before.count()
    frequent = {bytes(r["h"]) for r in linededup.frequent_lines(before).collect()}
    assert not any(linededup._digest(linededup.line_key(x)) in frequent for r in after.collect() for x in r["text"].encode().split(b"\n") if x.strip())
    before, after = kept["simhash_dedup"]
    groups = simhash.near_duplicates(before)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    before, after = kept["mix_sources"]
    count = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(count(after) - 1.5 * count(before)) <= 20
    before, after = kept["bpe"]
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sorted(map(str, bpe.digests(bpe.decode(bpe.encode(before, path), path)).collect())) == sorted(map(str, after.collect()))


def test_stages_bear_odd_documents(spark, odd, none, tmp_path):
    """Null ids, texts and sources, repeated rows, and columns with the names that operators use."""
    extra = [f"stage_{k}" for k in (0, 1)]
    for start, source in (("odd", odd), ("none", none)):
        docs, seen = source.withColumns({c: F.lit("own") for c in extra}), {}
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{start}-{name}")
            stage(spark, docs, "").write.parquet(path)
            docs = seen[name] = spark.read.parquet(path)
            if name != "bpe":
                assert docs.columns == columns and docs.where(" or ".join(f"{c} <> 'own'" for c in extra)).count() == 0
        if start == "none":
            assert all(d.count() == 0 for d in seen.values())
            continue
        ids = lambda name: sorted([r["doc_id"] for r in seen[name].collect()], key=str)
        assert not {2, 3, 6, 9} & set(ids("language_id")) and ids("language_id").count(4) in (0, 2)  # null, empty and letterless texts go
        assert ids("line_dedup") == ids("language_id")
        assert ids("simhash_dedup").count(4) <= 1 and 8 not in ids("simhash_dedup")  # copies of 4
        assert None in ids("language_id") and None in ids("simhash_dedup")
        assert seen["bpe"].count() == seen["mix_sources"].count() > 0


def test_one_row_of_each_group_stays_without_ids(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "entirely different words about rivers and mountains far away", "a third text that has nothing in common with those two"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[2]), (9, texts[2]), (None, texts[2]), (7, "unlike all others this one shares only its number")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), rows[-1]], key=str)
