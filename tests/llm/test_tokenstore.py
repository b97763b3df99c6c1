import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segmenta.llm import tokenstore as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_encoder_agrees_with_the_library(library):
    import random

    rng, e = random.Random(1), ts.encoder(PATH)
    for letters in ("ab thei 's  \n\n\t\r\x1c\x85　 Éñ1234.,日́​\U0001f600", "ab theI's  \nÉ1.,"):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
            assert np.frombuffer(e(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(e("x<|endoftext|>y"), "<u2").tolist() == library.encode("x<|endoftext|>y", add_special_tokens=False).ids


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 20000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        m = ts.PerfectHash.build(h)
        assert sorted(m.slots(h).tolist()) == list(range(len(h)))


@pytest.mark.parametrize("shard_bytes", [1 << 12, 1 << 24])
def test_rows(spark, odd, small, library, shard_bytes):
    for docs in (odd, small):
        folder = ts.write_store(docs, PATH, end_id=2, shard_bytes=shard_bytes)
        got = sorted(ts.read_store(spark, folder).collect(), key=lambda r: r["start"])
        rows = docs.select("doc_id", "text").collect()
        assert [r["key"] for r in got] == sorted([r["doc_id"] for r in rows], key=lambda i: (i is not None, i or 0))
        at, by = 0, {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])
        for r in got:
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert r["start"] == at and r["n_ids"] == len(ids)
            by[r["key"]].remove(ids)
            at += len(ids)
        store = ts.TokenStore(folder.removeprefix("file://"))
        for r in got[:40]:
            assert store.get(r["key"]) is not None
        one = got[-1]
        assert store.get(one["key"]).tolist() == np.frombuffer(one["ids"], "<u4").tolist()
        assert store.get(10**9) is None and store.get(-5) is None


def test_digests_and_empty(spark, none, small, library):
    folder = ts.write_store(none, PATH, end_id=2)
    assert ts.read_store(spark, folder).count() == 0
    r = ts.digests(ts.read_store(spark, ts.write_store(small, PATH, end_id=2))).orderBy("start").first()
    text = small.orderBy("doc_id").first()["text"]
    ids = [*library.encode(text, add_special_tokens=False).ids, 2]
    assert tuple(r) == (small.agg({"doc_id": "min"}).first()[0], 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_pieces_with_stops_agree_with_the_library(library):
    e = ts.encoder(PATH)
    for text in ("", " ", ".", " .", " a.", "a. b, c; d: e! f?", " a.. b.c 'tis it's, we'll. x1. 2, don't. É. été, a'", "a .b ,c", " s. 's. l'l"):
        assert np.frombuffer(e(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizer_files_are_encoded_whole(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "prefixed.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    e, t = ts.CachedEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not e.plain
    for text in ("word", "two words, here", " led"):
        assert np.frombuffer(e(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_a_task_closes_shards_at_their_bytes(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * 500) for k in range(50)], "doc_id long, text string").coalesce(1)
    folder = ts.write_store(docs, PATH, shard_bytes=4096)
    shards = spark.read.parquet(f"{folder}/manifest").collect()
    assert len(shards) > 40 and sum(r["documents"] for r in shards) == 50
    got = ts.read_store(spark, folder).orderBy("start").collect()
    assert [r["key"] for r in got] == list(range(50))
    assert [r["start"] for r in got[1:]] == np.cumsum([r["n_ids"] for r in got])[:-1].tolist()
