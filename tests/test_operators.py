"""Hand-worked cases, and independent models on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from segmenta.config import SemanticConfig, SplitConfig, WindowConfig
from segmenta.functions import text as T
from segmenta.functions import vectors as V
from segmenta.operators import embed, pooling, scoring, semantic, splits, structure
from segmenta.operators import spans as S
from segmenta.operators import tokens as K


def one(spark, column, *values, schema):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("A b.\n\nC d! E", ["A b.", "C d!", "E"]), ("x\ny\n\nz\n\n\nw", ["x", "y", "z", "w"]), ("One.Two. Three.", ["One.Two.", "Three."]), ("Hi. |  yo?", ["Hi.", "|", "yo?"]), ("", []), ("  ", [])],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences(F.col("t")), text, schema="t string") == want


def test_cleaning(spark):
    assert one(spark, T.clean_ascii(F.col("t")), "é\ta\r\n\n\n\nb", schema="t string") == "a\n\nb"
    assert one(spark, T.clean_line(F.col("t")), " a\tb\r\n\nc  d \n", schema="t string") == "a b| c d"
    assert one(spark, T.words(F.col("t")), "It's a WELL-known, fact_1 é!", schema="t string") == ["its", "a", "well-known", "fact_1", "é"]
    assert one(spark, T.split_long(F.col("t"), 2), "a b, c d", schema="t string") == ["a b", ", c", "d"]
    with pytest.raises(ValueError, match="limit"):
        T.split_long(F.lit("x"), 0)


def test_windows(spark):
    w = one(spark, K.windows(F.col("n"), WindowConfig(512, 50, 128)), 970, schema="n int")
    assert [(x["start"], x["end"]) for x in w] == [(0, 512), (462, 970), (924, 970)]
    assert [(x["own_from"], x["own_to"]) for x in w] == [(0, 487), (487, 947), (947, 970)]
    assert one(spark, K.windows(F.col("n"), WindowConfig(512, 50, 128)), 0, schema="n int") == []
    with pytest.raises(ValueError, match="overlap"):
        WindowConfig(10, 10)
    rng = random.Random(1)
    for _ in range(15):
        size = rng.randint(1, 20)
        c = WindowConfig(size, rng.randint(0, size - 1), 10)
        for r in spark.range(1, 60).select("id", K.windows(F.col("id").cast("int"), c).alias("w")).collect():
            assert [p for x in r["w"] for p in range(x["own_from"], x["own_to"])] == list(range(r["id"]))
            assert all(x["start"] <= x["own_from"] <= x["own_to"] <= x["end"] for x in r["w"])


def test_overlaps(spark):
    df = spark.createDataFrame([(["a", "b", "c", "b", "c"], ["b", "c", "x"]), (["token"], ["tokens", "y"]), ([], ["a"])], "p array<string>, q array<string>")
    assert [r[0] for r in df.select(K.exact_overlap(F.col("p"), F.col("q"))).collect()] == [2, 0, 0]
    assert [r["overlap"] for r in K.fuzzy_overlap(df, "p", "q").collect()] == [2, 1, 0]


def test_vectors(spark):
    s = "u array<double>, v array<double>"
    u, v = F.col("u"), F.col("v")
    assert one(spark, V.cosine_distance(u, v), [1.0, 0.0], [-1.0, 0.0], schema=s) == pytest.approx(2)
    assert one(spark, V.cosine_distance(u, v), [0.0, 0.0], [1.0, 0.0], schema=s) != one(spark, F.lit(1.0), 1, schema="a int")
    assert one(spark, V.normalize(u, "clamp"), [0.0, 0.0], [], schema=s) == [0.0, 0.0]
    assert all(x != x for x in one(spark, V.normalize(u, "raw"), [0.0, 0.0], [], schema=s))
    assert one(spark, V.normalize(u, "additive"), [3.0, 4.0], [], schema=s) == pytest.approx([0.6, 0.8])
    assert one(spark, V.similarity(u, v, "pearson"), [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], schema=s) == pytest.approx(1)
    assert one(spark, V.similarity(u, v, "manhattan"), [1.0], [4.0], schema=s) == pytest.approx(0.25)
    assert one(spark, V.ratio(F.lit(1.0), F.lit(0.0)), 1, schema="a int") == float("inf")
    for f, bad in ((V.distance, "pearson"), (V.similarity, "euclidean")):
        with pytest.raises(ValueError, match="metric"):
            f(u, v, bad)
    with pytest.raises(ValueError, match="pooling"):
        pooling.pool_columns(u, 2, "mode")


def test_wide_and_narrow_pools_agree(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    for m in pooling.METHODS:
        narrow = {r["label"]: r["embedding"] for r in pooling.pool(e, ["label"], "embedding", 64, m).collect()}
        monkeypatch.setattr(pooling, "WIDE", 1)
        wide = {r["label"]: r["embedding"] for r in pooling.pool(e, ["label"], "embedding", 64, m).collect()}
        monkeypatch.undo()
        assert all(wide[k] == pytest.approx(narrow[k]) for k in narrow) and len(wide) == len(narrow)


def test_spans(spark):
    tokens = K.token_rows(spark.createDataFrame([(1, "ab  cd, e")], "doc_id long, text string"))
    assert [(r["token"], r["c_start"], r["c_end"]) for r in tokens.orderBy("pos").collect()] == [("ab", 0, 2), ("cd", 4, 6), (",", 6, 7), ("e", 8, 9)]
    spans = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 6), (1, 2, 4, 7), (1, 3, 8, 30), (1, 4, 7, 8)], "doc_id long, span_id int, c_start int, c_end int")
    got = {r["span_id"]: (r["t_start"], r["t_end"]) for r in S.token_spans(tokens, spans).collect()}
    assert got == {0: (0, 1), 1: (0, 2), 2: (1, 3), 3: (3, 4), 4: (0, 4)}
    assert {r["span_id"]: r["t_start"] for r in S.token_spans(tokens, spans, gap="next").collect()}[1] == 1
    assert one(spark, S.char_spans(F.lit("aa aa b"), F.col("c")), ["aa", "aa", "b"], schema="c array<string>") == [(0, 2), (3, 5), (6, 7)]
    with pytest.raises(Exception, match="chunk not found"):
        one(spark, S.char_spans(F.lit("aa"), F.col("c")), ["b"], schema="c array<string>")
    frame = tokens.withColumn("embedding", F.array(F.col("pos").cast("double")))
    odd = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 2), (1, 2, 9, 10), (1, 3, 2, 9)], "doc_id long, span_id int, start int, end int")
    assert {r["span_id"]: r["embedding"] for r in pooling.late_pool(frame, odd, 1).collect()} == {0: [0.5], 1: [0.0], 2: [0.0], 3: [2.5]}
    assert {r["span_id"]: r["embedding"] for r in pooling.late_pool(frame, odd, 1, strict_end=True).collect()}[3] == [0.0]
    assert {r["span_id"]: r["embedding"] for r in pooling.pool_spans(frame, odd, 1).collect()}[1] is None


def literal_merge(counts, least, most):
    out, buffer, total, start = [], [], 0, 0
    for i, c in enumerate(counts):
        buffer.append(i)
        total += c
        if total > most:
            popped = 0
            a = buffer[0]
            while popped + counts[buffer[0]] <= most and len(buffer) > 1:
                popped += counts[buffer.pop(0)]
            out.append((a, buffer[0], popped))
            total -= popped
        if total >= least:
            out.append((buffer[0], i + 1, total))
            buffer, total = [], 0
    if buffer:
        out.append((buffer[0], len(counts), total))
    del start
    return out


def literal_groups(counts, limit, overlap):
    out, group, cur = [], [], 0
    for i, n in enumerate(counts):
        if cur + n > limit and group:
            tail, t = [], 0
            for j in reversed(group):
                if t + counts[j] > overlap:
                    break
                tail.insert(0, j)
                t += counts[j]
            out.append((group[0], group[-1] + 1, t))
            group, cur = tail, t
        group.append(i)
        cur += n
    return [*out, (group[0], group[-1] + 1, 0)]


def literal_chunks(items, c):
    out, chunk, total, start = [], [], 0, None
    for i, (t, r) in enumerate(items):
        chunk.append(i)
        total += t
        if (r is not None and r >= c.hard_ratio) or (total >= c.soft_min_tokens and (total >= c.max_tokens or (r is not None and r > c.min_ratio))):
            out.append((chunk[0], i, start))
            chunk, total, start = [i], t, r
    return [*out, (chunk[0], chunk[-1], start)]


def test_folds_against_literal_models(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        counts = [rng.randint(1, 12) for _ in range(rng.randint(1, 25))]
        rows.append((counts, [(c, rng.choice([None, 0.5, 2.4, 2.5, 2.6, 5.0, 9.0])) for c in counts]))
    df = spark.createDataFrame(rows, "c array<int>, i array<struct<t:int,r:double>>")
    c = SemanticConfig(sentence_max=12, sentence_min=5, group_limit=20, group_overlap=8, soft_min_tokens=15, max_tokens=40)
    got = df.select("c", "i", semantic.merged_spans(F.col("c"), 8, 12).alias("m"), semantic.group_spans(F.col("c"), 20, 8).alias("g"), semantic.chunk_spans(F.col("i"), c).alias("k")).collect()
    for r in got:
        assert [tuple(x) for x in r["m"]] == literal_merge(r["c"], 8, 12)
        assert [tuple(x) for x in r["g"]] == literal_groups(r["c"], 20, 8)
        assert [tuple(x) for x in r["k"]] == literal_chunks([tuple(x) for x in r["i"]], c)


def test_worked_semantic_cases(spark):
    assert [tuple(x) for x in one(spark, semantic.merged_spans(F.col("c"), 8, 10), [5, 3, 9, 1], schema="c array<int>")] == [(0, 2, 8), (2, 3, 9), (3, 4, 1)]
    assert [tuple(x) for x in one(spark, semantic.group_spans(F.col("c"), 10, 5), [4, 4, 4, 4], schema="c array<int>")] == [(0, 2, 4), (1, 3, 4), (2, 4, 0)]
    for second, want in ((2.6, [(0, 1, None), (1, 2, 2.6), (2, 3, 5.0)]), (2.5, [(0, 2, None), (2, 3, 5.0)])):
        items = [(30, None), (30, second), (30, 5.0), (30, None)]
        assert [tuple(x) for x in one(spark, semantic.chunk_spans(F.col("i"), SemanticConfig()), items, schema="i array<struct<t:int,r:double>>")] == want
    assert one(spark, semantic.format_ratio(F.col("r")), None, schema="r double") == "N/A"
    assert one(spark, semantic.format_ratio(F.col("r")), 2.6, schema="r double") == "2.6000"


def test_group_tokens_are_owned_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    c = SemanticConfig(sentence_max=40, sentence_min=8, group_limit=60, group_overlap=25)
    m = semantic.merged_sentences(docs, c)
    frame = semantic.group_token_frame(m, embed.HashEmbedder(2), c)
    n = m.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    got = frame.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m")).join(n, "doc_id").collect()
    assert got and all(r["k"] == r["d"] == r["n"] == r["m"] + 1 for r in got)


def types(spark, lines, **options):
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id long, pos int, text string")
    return [r["type"] for r in structure.classified(d, **options).orderBy("pos").collect()]


def test_line_types(spark):
    item, text = "ListItem", "NarrativeText"
    assert types(spark, ["1) one thing.", "2) two things."]) == [item, item]
    assert item not in types(spark, ["1. one thing.", "2. two things."])
    assert types(spark, ["1. one thing.", "2. two things."], dotted_lists=True) == [item, item]
    assert types(spark, ["1a x.", "1b x."]) == [item, item]
    assert item not in types(spark, ["1st x.", "2nd x."])
    assert types(spark, ["- x.", "- y."]) == [item, item]
    assert types(spark, ["3 apples are here."]) == [text]
    assert types(spark, ["Chapter One", "this line is longer than the first one."])[0] == "Title"
    assert types(spark, ["word here.", "x."])[0] == text


def scored_frame(spark):
    rows = [("Title", 1, 5), ("Title", 1, 5), ("NarrativeText", 1, 150), ("ListItem", 1, 20), ("ListItem", 1, 20), ("Title", 2, 10), ("Text", 2, 50)]
    return spark.createDataFrame([(1, k, t, f"text {k}", n, p) for k, (t, p, n) in enumerate(rows)], "doc_id long, pos int, type string, text string, token_size int, page_number int")


def test_worked_scores_and_splits(spark):
    s = scoring.split_scores(scored_frame(spark))
    assert [r["score"]["sum"] for r in s.orderBy("pos").collect()] == pytest.approx([7, 3, 2, 6, 1, 5, 1])
    ini = splits.initial_splits(s)
    assert sorted(r["split_idx"] for r in ini.collect()) == [0, 3]
    r = splits.chunk_ranges(s, ini)
    assert [x["chunk_score"] for x in r.orderBy("split_idx").collect()] == pytest.approx([3.821622, 2.594595], abs=1e-6)
    assert splits.average_chunk_score(r).first()["avg_chunk_score"] == pytest.approx(3.208108, abs=1e-6)
    assert sorted(x["split_idx"] for x in splits.repaired_splits(s, ini).collect()) == [0, 3]
    assert sorted(x["split_idx"] for x in splits.split_points(s).collect())[0] == 0
    assert [r["pos"] for r in splits.top_elements(s, 3).orderBy("rank").collect()] == [0, 3, 5]
    single = scoring.split_scores(scored_frame(spark).where("pos = 0"))
    assert single.first()["score"]["sum"] == 5


def test_phrases(spark):
    e = scored_frame(spark).withColumn("text", F.when(F.col("pos") == 2, "some quick brown foxes").when(F.col("pos") == 5, "Quick Brown").otherwise("nothing"))
    hits = {r["phrase"]: (r["first"], r["last"], round(r["score"], 3)) for r in scoring.phrase_hits(e, ["quick brown", "brown fox", "zebra crossing"]).collect()}
    assert hits[0] == (2, 2, 1.0) and hits[1][0] == 2 and 2 not in hits
    d = scoring.phrase_condition(e, spark.createDataFrame([(1, 0, 5, 5, 1.0), (1, 1, 2, 2, 1.0), (1, 2, 6, 6, 1.0)], "doc_id long, phrase int, first int, last int, score double"))
    assert [r["phrases_condition"] for r in d.orderBy("pos").collect()] == [0, 0, 0, 0, 0, 10.0, 0]


def test_phrases_against_every_place(spark):
    rng = random.Random(11)
    vocabulary = ["river", "rivers", "mountain", "mountains", "stone", "stones", "light", "night", "bright", "a", "an", "the", "of"]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(60)]
    phrases = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8))) for _ in range(25)] + ["", "!!!"]
    rows = [(k, p, " ".join(t[p * 7 : p * 7 + 7])) for k, t in enumerate(texts) for p in range(-(-len(t) // 7))]
    df = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    for threshold in (0.8, 0.65, 1.0):
        want = set()
        for k, t in enumerate(texts):
            for n, p in enumerate(phrases):
                w = p.replace("!", "").split()
                scores = [(sum(scoring.word_similarity(x, y) for x, y in zip(w, t[s : s + len(w)], strict=True)) / len(w), -s) for s in range(len(t) - len(w) + 1) if w]
                if scores and max(scores)[0] >= threshold:
                    score, back = max(scores)
                    want.add((k, n, -back // 7, (len(w) - 1 - back) // 7, round(score, 9)))
        got = {(r["doc_id"], r["phrase"], r["first"], r["last"], round(r["score"], 9)) for r in scoring.phrase_hits(df, phrases, threshold=threshold).collect()}
        assert got == want and want
    with pytest.raises(ValueError, match="threshold"):
        scoring.phrase_hits(df, phrases, threshold=0.0)


@pytest.mark.parametrize(("tokens", "factor"), [(29, 0), (30, 0.3), (400, 1.0), (800, 0.3), (801, 0)])
def test_size_factor(tokens, factor):
    d = splits.Document([tokens], [10.0], SplitConfig())
    assert d.score(0, 1) == pytest.approx(10 * factor)


def test_local_search_invariants():
    rng = random.Random(3)
    c = SplitConfig()
    for _ in range(150):
        n = rng.randint(1, 60)
        d = splits.Document([rng.randint(0, 300) for _ in range(n)], [rng.choice([1.0, 2.0, 5.0, 7.5]) for _ in range(n)], c)
        start = sorted({0, *(rng.randrange(n) for _ in range(rng.randint(0, 6)))})
        repaired = splits.zero_repair(d, start)
        found = splits.refine(d, repaired)
        for points in (repaired, found):
            assert points == sorted(set(points)) and all(0 <= p < n for p in points) and points[0] == 0
        assert splits.refine(d, repaired) == found
    with pytest.raises(ValueError, match="required"):
        SplitConfig(min_tokens=400)
