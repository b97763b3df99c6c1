"""Slow models of the sequential rules, written from their description, against the queries on whole tables."""

import pytest
from pyspark.sql import functions as F

from segmenta.config import SemanticConfig, SplitConfig, WindowConfig
from segmenta.functions import text as T
from segmenta.operators import embed, pooling, scoring, semantic, splits
from segmenta.operators import spans as S
from segmenta.operators import tokens as K
from segmenta.plans import structure_queries, text_queries

SF = "/root/testdata/sf0.001"


class Model:
    """Split points of one document, as lists of elements that are added up anew each time."""

    def __init__(self, sizes, scores, c=None):
        self.sizes, self.scores, self.c, self.n = sizes, scores, c or SplitConfig(), len(sizes)

    def tokens(self, a, b):
        return sum(self.sizes[a:b])

    def chunk_score(self, a, b):
        total, c = self.tokens(a, b), self.c
        if total < c.min_tokens or total > c.max_tokens:
            return 0.0
        if total < c.expected_tokens:
            share = (c.expected_tokens - total) / (c.expected_tokens - c.min_tokens)
        else:
            share = (total - c.expected_tokens) / (c.max_tokens - c.expected_tokens)
        return self.scores[a] * (0.3 + 0.7 * (1 - share))

    def mean(self, points):
        ends = points[1:] + [self.n]
        positive = [s for s in map(self.chunk_score, points, ends) if s > 0]
        return sum(positive) / len(positive) if positive else 0.0

    def initial(self):
        k = max(1, max(1, sum(self.sizes) // self.c.expected_tokens) * self.c.multiplier)
        return sorted(sorted(range(self.n), key=lambda p: (-self.scores[p], p))[:k])

    def repaired(self, initial):
        c, result = self.c, []
        for s, e in zip(initial, initial[1:] + [self.n], strict=True):
            result.append(s)
            if self.chunk_score(s, e) > 0:
                continue
            if self.tokens(s, e) < c.min_tokens and len(result) > 1:
                result.remove(s)
            left = s
            while self.tokens(left, e) > c.max_tokens:
                by_score = sorted(range(left, e), key=lambda p: self.scores[p], reverse=True)
                fitting = [p for p in by_score if c.expected_tokens - c.min_tokens <= self.tokens(left, p) <= c.expected_tokens + c.max_tokens and self.tokens(p, e) > 0]
                if not fitting:
                    break
                left = fitting[0]
                result.append(left)
        return sorted(set(result))

    def window(self, points, start, end):
        best = list(points)
        for shift in (-1, 0, 1):
            if len(best) < 3:
                break
            middle = [min(max(p + shift, start), end) for p in best[1:-1]]
            shifted = [p for p in sorted({best[0], *middle, best[-1]}) if p < self.n]
            if self.mean(shifted) > self.mean(best):
                best = shifted
        while True:
            size, k = len(best), 1
            while 0 < k < len(best) - 1:
                without = [p for p in best if p != best[k]]
                if self.mean(without) > self.mean(best) and self.tokens(best[k - 1], best[k + 1]) <= self.c.max_tokens:
                    best = without
                else:
                    k += 1
            if len(best) == size:
                break
        for k in range(1, len(best) - 1):
            if k + 1 >= len(best):
                break
            middle = (best[k] + best[k + 1]) // 2
            with_it = sorted({*best, middle})
            if middle not in best and self.mean(with_it) > self.mean(best):
                best = with_it
        forced = set(best)
        for p, following in zip(best, best[1:] + [end], strict=True):
            while self.tokens(p, following) > self.c.max_tokens or (self.chunk_score(p, following) == 0 and self.tokens(p, following) > self.c.min_tokens):
                middle = (p + following) // 2
                if not p < middle < following:
                    break
                forced.add(middle)
                p = middle
        return sorted(forced)

    def refined(self, points):
        current = list(points)
        for _ in range(100):
            p, changed, i = list(current), False, 0
            while i < len(p) - 1:
                w = p[i : i + 3]
                new = self.window(w, w[0], p[i + 2] if i + 2 < len(p) else self.n)
                if new != w:
                    p = p[:i] + new + p[i + 3 :]
                    changed = True
                i += 1
            p = sorted(set(p))
            if not changed or p == current:
                return current
            current = p
        return current


def test_split_search_over_all_documents(spark):
    scored = scoring.split_scores(structure_queries._elements(spark, SF)).select("doc_id", "pos", "token_size", F.col("score.sum").alias("score")).cache()
    docs = {}
    for r in scored.orderBy("doc_id", "pos").collect():
        docs.setdefault(r["doc_id"], []).append((r["token_size"], r["score"]))
    want = {}
    for k, rows in docs.items():
        m = Model(*map(list, zip(*rows, strict=True)))
        start = m.initial()
        want[k] = (m.repaired(start), m.refined(start), m.refined(m.repaired(start)))
    for at, query in enumerate((structure_queries.zero_repair, structure_queries.refine, structure_queries.split_points)):
        got = {}
        for r in query(spark, SF).collect():
            got.setdefault(r["doc_id"], []).append(r["split_idx"])
        assert {k: sorted(v) for k, v in got.items()} == {k: w[at] for k, w in want.items() if w[at]}


def test_fuzzy_overlap_over_all_windows(spark):
    from difflib import SequenceMatcher
    from functools import lru_cache

    near = lru_cache(None)(lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.7)
    rows = text_queries._neighbours(spark, SF).select("doc_id", "win_id", "before", "tokens").limit(600).collect()
    got = {(r["doc_id"], r["win_id"]): r["overlap"] for r in text_queries.overlap_fuzzy(spark, SF).collect()}
    for r in rows:
        x, y = r["before"], r["tokens"]
        fits = [n for n in range(min(len(x), len(y)) + 1) if all(near(x[len(x) - n + k], y[k]) for k in range(n))]
        assert got[r["doc_id"], r["win_id"]] == max(fits)


def test_distances_by_frames_and_by_spans_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id % 8 = 0")
    for method in ("mean", "max", "min", "sum"):
        c = SemanticConfig(sentence_max=40, sentence_min=8, group_limit=60, group_overlap=25, pooling=method, current_chunk_size=2)
        merged = semantic.sentence_arrays(docs, c)
        frame = semantic.group_token_frame(merged, embed.HashEmbedder(3), c, normalize=True).cache()
        columns = ["sent", "n_tokens", "prev_distance", "next_distance", "current_text"]
        told = lambda df: {(r["doc_id"], r["sent"]): [r[x] for x in columns[1:]] + list(r["embedding"]) for r in df.collect()}
        frames = told(semantic.sentence_distances(merged, frame, 3, c))
        spans = told(semantic.sentence_distances(merged, frame.drop("sent", "text"), 3, c))
        monkeypatch.setattr(pooling, "WIDE", 1)
        wide = told(semantic.sentence_distances(merged, frame, 3, c))
        monkeypatch.undo()
        assert frames.keys() == spans.keys() == wide.keys() and frames
        for k, x in frames.items():
            for other in (spans[k], wide[k]):
                assert all(p == q if isinstance(p, str) or p is None else p == pytest.approx(q, abs=1e-8) for p, q in zip(x, other, strict=True))


def test_late_chunks_are_late_pooling_over_looked_up_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id % 8 = 1")
    d = docs.withColumn("s", T.sentences(F.col("text"))).withColumn("text", F.array_join("s", " "))
    chunks = d.select("doc_id", F.posexplode(S.char_spans(F.col("text"), F.col("s"))).alias("span_id", "x")).select("doc_id", "span_id", "x.*")
    tokens = K.token_rows(d.select("doc_id", "text"))
    spans = S.token_spans(tokens, chunks).select("doc_id", "span_id", F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    e = embed.HashEmbedder(3)
    want = {(r["doc_id"], r["span_id"]): (r["n_tokens"], r["embedding"]) for r in pooling.late_pool(embed.token_embeddings(tokens, e, 500), spans, 3).collect()}
    got = {(r["doc_id"], r["sent"]): (r["n_tokens"], r["embedding"]) for r in semantic.late_chunks(docs, e, 3, 500).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in got)


def test_spans_at_gaps_against_all_tokens(spark):
    text = "ab  cd, e   fg.  "
    tokens = K.token_rows(spark.createDataFrame([(1, text), (2, "   ")], "doc_id long, text string"))
    all_ = [(r["c_start"], r["c_end"]) for r in tokens.where("doc_id = 1").orderBy("pos").collect()]
    rows = [(i, 100 * a + b, a, b) for i in (1, 2) for a in range(len(text)) for b in range(a + 1, len(text) + 3)]
    spans = spark.createDataFrame(rows, "doc_id long, span_id int, c_start int, c_end int")
    for gap in ("zero", "next"):
        got = {(r["doc_id"], r["span_id"]): (r["t_start"], r["t_end"]) for r in S.token_spans(tokens, spans, gap=gap).collect()}
        for i, k, a, b in rows:
            known = all_ if i == 1 else []
            end = next((p for p, (x, y) in enumerate(known) if x <= b - 1 < y), None)
            start = next((p for p, (x, y) in enumerate(known) if x <= a < y), None)
            if start is not None and start > (len(known) if end is None else end):
                start = None
            if start is None and gap == "next":
                start = next((p for p, (x, _) in enumerate(known) if x >= a), None)
            assert got[i, k] == (start or 0, len(known) if end is None else end + 1)


def test_owned_windows_against_the_list(spark):
    c = WindowConfig(7, 3, 5)
    tokens = spark.range(1, 40).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("id").cast("int") - 1)).alias("pos"))
    want = set()
    for r in spark.range(1, 40).select("id", K.windows(F.col("id").cast("int"), c).alias("w")).collect():
        want |= {(r["id"], w["win_id"], p, p - w["start"], w["own_from"] <= p < w["own_to"]) for w in r["w"] for p in range(w["start"], w["end"])}
    assert {(r["doc_id"], r["win_id"], r["pos"], r["j"], r["owned"]) for r in K.owned(tokens, c).collect()} == want


def test_a_long_document_takes_linear_time(spark):
    import time

    c = SemanticConfig(sentence_max=60, sentence_min=5, group_limit=120, group_overlap=30)
    took = {}
    for n in (10_000, 10_000, 100_000):
        text = " ".join(f"This is sentence number {k} of a long text." for k in range(n))
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        assert semantic.merged_sentences(d, c).count() == n
        assert semantic.context_groups(semantic.sentence_arrays(d, c), c).agg(F.max("last")).first()[0] == n - 1
        took[n] = time.time() - began
    assert took[100_000] < 60 * max(took[10_000], 0.5)


def test_wide_pools_keep_their_extras(spark, monkeypatch):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", F.col("vec_id").cast("int").alias("pos"), F.col("vec_id").cast("string").alias("token"), "embedding")
    spans = spark.createDataFrame([(k, 0, 3 * k, 3 * k + 40) for k in range(10)], "label int, span_id int, start int, end int")
    narrow = pooling.pool_frame(e, ["label"], 64).orderBy("label").collect(), pooling.late_pool(e, spans, 64, "label").orderBy("label").collect()
    monkeypatch.setattr(pooling, "WIDE", 1)
    wide = pooling.pool_frame(e, ["label"], 64).orderBy("label").collect(), pooling.late_pool(e, spans, 64, "label").orderBy("label").collect()
    assert [(r["label"], r["tokens"]) for r in wide[0]] == [(r["label"], r["tokens"]) for r in narrow[0]]
    assert [(r["label"], r["n_tokens"]) for r in wide[1]] == [(r["label"], r["n_tokens"]) for r in narrow[1]]
    for a, b in zip(wide[0] + wide[1], narrow[0] + narrow[1], strict=True):
        assert a["embedding"] == pytest.approx(b["embedding"])


def test_plug_in_text_embedder(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "abc"), (4, "")], "id long, text string")
    seen = embed.FunctionTextEmbedder(lambda: lambda texts: [[len(t), 1] for t in texts], 2, batch=2).embed_texts(d)
    assert {r["id"]: r["embedding"] for r in seen.collect()} == {1: [1.0, 1.0], 2: None, 3: [3.0, 1.0], 4: [0.0, 1.0]}
