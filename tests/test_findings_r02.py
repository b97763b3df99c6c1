"""What the findings of round 2 were about."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmenta.functions import vectors as V
from segmenta.operators import scoring, semantic


def one(spark, column, *values, schema):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def test_distances_do_not_depend_on_the_order_of_tokens(spark):
    rng = np.random.default_rng(5)
    rows = [(1, s, f"s{s}" if i == 0 else None, [float(x) for x in rng.normal(size=2)]) for s in range(3) for i in range(40)]
    seen = set()
    for k in range(4):
        frame = spark.createDataFrame([rows[i] for i in (rng.permutation(len(rows)) if k else range(len(rows)))], "doc_id int, sent int, text string, embedding array<double>").coalesce(1)
        found = semantic.sentence_distances(None, frame, 2, digits=14).orderBy("sent").collect()
        seen.add(tuple((r["prev_distance"], r["next_distance"], *r["embedding"]) for r in found))
    assert len(seen) == 1


def test_ratios_and_distances_are_rounded_as_sql_rounds_them(spark):
    assert [one(spark, semantic.format_ratio(F.col("r")), x, schema="r double") for x in (0.15625, float("nan"), float("inf"), -float("inf"))] == ["0.1562", "nan", "inf", "-inf"]
    assert one(spark, V.rounded(F.col("r"), 9), 0.7813991554999999, schema="r double") == 0.781399156  # its product is a half, its decimal digits are less
    assert one(spark, V.rounded(F.col("r"), 9), 1e300, schema="r double") == 1e300


def test_words_are_looked_up_many_at_once_without_losing_a_place():
    """Thousands of words that are near to no phrase took a sequence comparison for each phrase word of like characters."""
    rng = np.random.default_rng(3)
    made = lambda n: ["".join(rng.choice(list("etaoinshr"), int(rng.integers(1, 12)))) for _ in range(n)]
    vocabulary = [*made(300), "", "é" * 5, "aaaaaaaab", "x" * 300]
    index = scoring.PhraseIndex([" ".join(vocabulary[i : i + 20]) for i in range(0, 300, 20)] + ["aaaaaaab aaaab"], 0.8)
    compared, before = [], scoring.word_similarity
    scoring.word_similarity = lambda a, b: compared.append(1) or before(a, b)
    try:
        words = made(2000) + vocabulary
        n, places, bounds = index.stand_for(words)
    finally:
        scoring.word_similarity = before
    assert not compared and len(n) == len(words) and n.sum() == len(places) == len(bounds)
    first = np.cumsum(n) - n
    for w in range(0, len(words), 41):
        got = dict(zip(map(tuple, places[first[w] : first[w] + n[w]].tolist()), bounds[first[w] : first[w] + n[w]].tolist(), strict=True))
        for p, phrase in enumerate(index.phrases):
            for j, x in enumerate(phrase):
                if (agree := before(x, words[w])) >= index.near:
                    assert got[p, j] >= agree - 1e-6


def test_a_phrase_is_found_across_the_blocks_of_a_long_text():
    index = scoring.PhraseIndex(["quick brown foxes jump"], 0.8)
    for at in (0, index.STARTS - 2, index.STARTS, 2 * index.STARTS - 1):
        words = ["zzz"] * at + ["quick", "brown", "foxes", "jumps"] + ["zzz"] * 5
        got = index.stand_for(words)
        assert [h[:3] for h in index.hits(words, *got)] == [(0, at, at + 3)]


def test_fingerprints_are_compared_by_equal_parts():
    """Two tiles took all their pairs; now those alone that have a part of the bits in common, with the same sets."""
    pytest.importorskip("xxhash")
    from segmenta.llm import simhash

    rng = np.random.default_rng(8)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    near = a[:500].copy()
    for k in range(4):  # up to four bits away, in any parts
        near ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    far = a[500:600] ^ np.uint64(0b11111 << 20)

    def sets(values, edges):
        at = {int(v): k for k, v in enumerate(values)}
        label = np.arange(len(values))
        simhash.hook(label, np.array([at[int(x)] for x in edges[0]], np.int64), np.array([at[int(x)] for x in edges[1]], np.int64))
        return label.tolist()

    b = np.unique(np.concatenate([near, far]))
    for left, right in ((np.unique(np.concatenate([a, b])), None), (np.setdiff1d(a, b), b), (a[:1], None), (a[:1], b[:1])):
        values = left if right is None else np.concatenate([left, right])
        found = simhash._by_parts(left, right, 4)
        if len(left) > 1:
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ (left if right is None else right)) <= 4)
            label = np.arange(len(values))
            simhash.hook(label, i, j + (0 if right is None else len(left)))
            assert sets(values, found) == label.tolist() and sum(label != np.arange(len(values))) >= 400
        assert simhash.stars(left, right) is not None
    close = np.arange(4000, dtype=np.uint64)  # most parts are equal
    assert simhash._by_parts(close, None, 4) is None and len(simhash.stars(close, None)[0]) == 3999


def test_vectors_are_not_shuffled_again_for_each_pair_of_blocks(spark):
    """Each block went to every partner, so the shuffle grew with the square of the vectors."""
    from segmenta.llm import covertree

    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 4))
    points = spark.createDataFrame([(k, [float(e) for e in x], 1) for k, x in enumerate(v)], "node long, v array<double>, mass long")
    found = covertree.link(points, block=32)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "v#" not in plan and "rows#" not in plan
    u = covertree.unit(v)
    want = {k: int(n) for k, n in enumerate(((u @ u.T) >= covertree.THRESHOLD).sum(axis=1) - 1) if n}
    got = {}
    for r in found.collect():
        got[r["node"]] = got.get(r["node"], 0) + r["links"]
    assert {k: n for k, n in got.items() if n} == want and want
