import pytest
from pyspark.sql import functions as F

from segmenta.llm import mixing, queries


def targets(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_rows(odd, small, block):
    for docs in (odd, small):
        base, plan, reads = mixing.mix(docs, block=block, shard_slots=32)
        rows = mixing.taken(base, plan, reads, block).collect()
        want = sorted(str((r["doc_id"], len((r["text"] or "").split()))) for r in docs.select("doc_id", "text").collect() for _ in [0]) if docs is small else None
        assert len(rows) == docs.count() and (want is None or sorted(str((r["key"], r["size"])) for r in rows) == want)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        by = {r["source"]: r for r in plan.collect()}
        goal = targets({s: r["source_size"] for s, r in by.items()})
        for s, r in by.items():
            assert r["target"] == pytest.approx(goal[s])
            assert reads.where(F.col("source").eqNullSafe(s)).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] == round(r["target"] + 1e-9)
        assert sum(r["taken"] for r in rows) == reads.agg(F.sum("words")).first()[0]
        again = mixing.taken(*mixing.mix(docs, block=block, shard_slots=32), block).collect()
        assert sorted(map(str, again)) == sorted(map(str, rows))


def test_blocks_and_documents_hold_what_was_taken(odd):
    base, plan, reads = mixing.mix(odd, block=64)
    mixed = mixing.mixed_blocks(odd, base, reads, block=64)
    assert mixed.where(F.size("words") == 0).count() == 0
    taken = mixing.taken(base, plan, reads, 64).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(F.size("words"))).first()[0] == taken
    docs = mixing.mixed_documents(odd, base, reads, block=64)
    assert docs.columns == odd.columns
    assert docs.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == taken
    whole = {r["text"] for r in odd.collect()}
    assert all(any(r["text"].strip() in (w or "") for w in whole) or r["doc_id"] == 5 for r in docs.collect())


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 10, 97):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("s"))).collect()]
        assert sorted(got) == list(range(n))


def test_empty(none):
    base, plan, reads = mixing.mix(none)
    assert mixing.taken(base, plan, reads).count() == 0


@pytest.mark.parametrize("block", [7, 64])
def test_blocks_carry_their_documents(odd, small, block):
    for docs in (odd, small):
        base, plan, reads = mixing.mix(docs, block=block)
        mixed = mixing.mixed_blocks(docs, base, reads, block=block)
        assert sorted(map(str, mixing.counted(base, plan, mixed).collect())) == sorted(map(str, mixing.taken(base, plan, reads, block).collect()))
        texts = {(r["source"], r["key"], r["h"]): r["text"].split() for r in docs.select("text", "source", F.col("doc_id").alias("key"), F.xxhash64("text").alias("h")).collect() if r["text"]}
        named = base.where("size > 0").withColumn("source", mixing._source())
        of = {(r["source"], r["bucket"], r["start"]): texts[r["source"], r["key"], r["h"]] for r in named.collect()}
        blocks = {(r["source"], r["bucket"], r["block"]): r["words"] for r in mixing.packed_blocks(docs, base, block=block).collect()}
        for s, b, k in blocks:
            assert len(blocks[s, b, k]) == block or (s, b, k + 1) not in blocks
        for s, b, start in of:
            for at, w in enumerate(of[s, b, start], start):
                assert blocks[s, b, at // block][at % block] == w
        # what each document gives is what the drawn slots' blocks hold of it
        want = {}
        for r in reads.collect():
            for at in range(r["block"] * block, r["block"] * block + r["words"]):
                want[r["source"], r["bucket"], at] = want.get((r["source"], r["bucket"], at), 0) + 1
        got = {(r["source"], r["key"], r["size"], r["taken"]) for r in mixing.counted(base, plan, mixed).where("size > 0").collect()}
        for r in named.collect():
            n = sum(want.get((r["source"], r["bucket"], at), 0) for at in range(r["start"], r["start"] + r["size"]))
            assert (r["source"], r["key"], r["size"], n) in got


def test_several_buckets(small, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)  # of ten of each source
    base, plan, reads = mixing.mix(small, block=50, shard_slots=16)
    assert base.select("bucket").distinct().count() == 4
    for r in plan.collect():
        mine = reads.where((F.col("s_name") == r["s_name"]) & (F.col("s_null") == r["s_null"]))
        assert mine.agg(F.sum("words")).first()[0] == round(r["target"] + 1e-9)
        # an epoch reads no block twice, and a whole one reads them all
        per = mine.groupBy("epoch").agg(F.count("*").alias("n"), F.countDistinct("bucket", "block").alias("m")).collect()
        assert all(x["n"] == x["m"] and (x["epoch"] == r["epochs"] or x["n"] == r["blocks"]) for x in per)
    mixed = mixing.mixed_blocks(small, base, reads, block=50)
    assert sorted(map(str, mixing.counted(base, plan, mixed).collect())) == sorted(map(str, mixing.taken(base, plan, reads, 50).collect()))


def test_sources_named_like_the_marks_of_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (2, "d e f", "\0"), (3, "g h i", ""), (4, "j k", "n")], "doc_id long, text string, source string")
    base, plan, reads = mixing.mix(docs)
    assert plan.count() == 4
    rows = mixing.taken(base, plan, reads).collect()
    assert sorted((r["key"], r["size"]) for r in rows) == [(1, 3), (2, 3), (3, 3), (4, 2)]
    assert {r["text"].split()[0][0] for r in mixing.mixed_documents(docs, base, reads).collect()} <= set("adgjbcefhik")


def test_query_counts_the_joined_blocks(spark, monkeypatch):
    whole = queries.op7_mixing(spark, "/root/testdata/sf0.001").collect()
    assert sum(r["taken"] for r in whole) > 0
    join = mixing.mixed_blocks
    monkeypatch.setattr(mixing, "mixed_blocks", lambda *of: join(*of).withColumn("words", F.slice("words", 1, 10)))
    cut = queries.op7_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(cut) == len(whole) and 0 < sum(r["taken"] for r in cut) < sum(r["taken"] for r in whole) / 50
