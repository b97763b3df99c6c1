"""Split scores of elements: how well a chunk could begin at each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.config import SplitConfig
from segmenta.functions import text as T

PHRASE_HIT, PHRASE_NEAR, PHRASE_ELSE = 30.0, 10.0, 5.0


def title_condition(kind: Column) -> Column:
    return F.when(kind == "Title", 5.0).when(kind == "NarrativeText", 2.0).otherwise(1.0)


def _w(key: str):
    return Window.partitionBy(key).orderBy("pos")


def token_condition(elements: DataFrame, key: str = "doc_id", threshold: int = 100) -> DataFrame:
    """``token_condition``: on a Title, 5 and 0.01 for each token beyond ``threshold`` under it (itself included, up to the next Title)."""
    d = elements.withColumn("section", F.count(F.when(F.col("type") == "Title", 1)).over(_w(key)))
    total = F.sum(F.coalesce("token_size", F.lit(0))).over(Window.partitionBy(key, "section"))
    return d.withColumn("token_condition", F.when((F.col("type") == "Title") & (total > threshold), 5 + 0.01 * (total - threshold)).otherwise(0.0)).drop("section")


def first_list_item(kind: Column, key: str = "doc_id") -> Column:
    before = F.coalesce(F.lag(kind).over(_w(key)), F.lit(""))
    return F.when((kind == "ListItem") & (before != "ListItem"), 5.0).otherwise(0.0)


def word_similarity(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


class PhraseIndex:
    """Phrases, and which document words could stand for their words.

    If a phrase's words agree by ``threshold`` on average, then at least ``(threshold - NEAR) / (1 - NEAR)`` of them agree by ``NEAR``, for
    any NEAR below the threshold.  No words agree by more than twice the characters that they share by the characters that they have.  So places are
    counted by words that are near by this bound, which takes one matrix product for many words at once; of those with enough of them the
    bounds are added up, and only what still reaches the threshold is compared in full.  Nothing that reaches the threshold is lost."""

    #: Of the threshold, what a near word has; remembered pairs of words; occurrences of a character that are told apart; words in a product; starts in a count.
    NEAR, MEMO, OCCUR, ROWS, STARTS = 0.94, 200_000, 3, 512, 8192

    def __init__(self, phrases: list[str], threshold: float):
        self.threshold, self.near = threshold, threshold * self.NEAR
        self.phrases = [_phrase_words(p) for p in phrases]
        self.lengths = np.array([len(w) for w in self.phrases], np.int64)
        self.least = np.maximum(1, np.ceil(self.lengths * (threshold - self.near) / (1 - self.near) - 1e-6)).astype(np.int64)
        places: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.phrases):
            for j, w in enumerate(words):
                places.setdefault(w, []).append((k, j))
        self.known = sorted(places, key=lambda w: (len(w), w))
        #: Places of the known words, one after another, and where those of a word begin.
        self.places = np.array([p for w in self.known for p in places[w]], np.int32).reshape(-1, 2)
        self.begin = np.concatenate([[0], np.cumsum([len(places[w]) for w in self.known])]).astype(np.int64)
        self.sizes = np.array([len(w) for w in self.known], np.int64)
        self.shared = self._features(self.known)[0].T.copy()
        self.ratios: dict[tuple[str, str], float] = {}

    def _features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: which characters by code modulo 64 it has once, twice and so on; how many it has beyond these; its length.  What two
        words have in common of these, and what one has beyond, is no less than what they share of characters."""
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) & 63
        counts = np.bincount(np.repeat(np.arange(len(words)), sizes) * 64 + codes, minlength=64 * len(words)).reshape(-1, 64)
        has = np.concatenate([counts > n for n in range(self.OCCUR)], axis=1).astype(np.float32)
        return has, np.maximum(counts - self.OCCUR, 0).sum(axis=1), sizes

    def ratio(self, phrase_word: str, word: str) -> float:
        if phrase_word == word:
            return 1.0
        if (found := self.ratios.get((phrase_word, word))) is None:
            if len(self.ratios) >= self.MEMO:
                self.ratios.clear()
            found = self.ratios[phrase_word, word] = word_similarity(phrase_word, word)
        return found

    def stand_for(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(n, places, bounds)``: how many places each word could stand at, (phrase, place) of these one word after another, and how far it can agree."""
        n, found, bounds = np.zeros(len(words), np.int64), [self.places[:0]], [np.zeros(0, np.float32)]
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(order), self.ROWS):
            rows = order[at : at + self.ROWS]
            has, beyond, sizes = self._features([words[i] for i in rows])
            # lengths that leave enough to share
            low, high = np.searchsorted(self.sizes, [sizes[0] * self.near / (2 - self.near) - 1e-6, sizes[-1] * (2 - self.near) / self.near + 1e-6])
            shared = has @ self.shared[:, low:high]
            shared += beyond[:, None].astype(np.float32)
            np.minimum(shared, np.minimum(sizes[:, None], self.sizes[low:high]).astype(np.float32), out=shared)
            i, k = np.nonzero(shared >= ((sizes[:, None] + self.sizes[low:high]) * (self.near / 2) - 1e-3).astype(np.float32))
            bound = 2 * shared[i, k] / (sizes[i] + self.sizes[low + k]).astype(np.float32)
            k += low
            each = self.begin[k + 1] - self.begin[k]
            n[rows] = np.bincount(i, weights=each, minlength=len(rows)).astype(np.int64)
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            found.append(self.places[np.repeat(self.begin[k], each) + inside])
            bounds.append(np.repeat(bound, each))
        # back from the order of lengths to that of the words
        places, bounds = np.concatenate(found), np.concatenate(bounds)
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        back = _ranges(first, n)
        return n, places[back], bounds[back]

    def hits(self, words: list[str], n: np.ndarray, places: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(phrase, first word, last word, score) of the best place of each phrase, the earliest of equal ones.  The others: what ``stand_for``
        gives for each of the words."""
        k, j = places.T.astype(np.int64)
        start = np.repeat(np.arange(len(words)), n) - j
        inside = (start >= 0) & (start + self.lengths[k] <= len(words))
        k, start, bounds = k[inside], start[inside], bounds[inside]
        best: dict[int, tuple[float, int]] = {}
        block = start // self.STARTS
        cuts = [np.arange(len(k))] if len(words) <= self.STARTS else [np.flatnonzero(block == b) for b in range(int(block.max(initial=-1)) + 1)]
        for b, rows in enumerate(cuts):
            width = min(self.STARTS, len(words))
            at = k[rows] * width + start[rows] - b * self.STARTS
            counts = np.bincount(at)
            full = np.flatnonzero(counts)
            full = full[counts[full] >= self.least[full // width]]
            if not len(full):
                continue
            # a word that is not near agrees by less than near
            sums, size = np.bincount(at, weights=bounds[rows])[full], self.lengths[full // width]
            full = full[sums + (size - counts[full]) * self.near >= self.threshold * size - 1e-3 * size]
            for p, s in zip((full // width).tolist(), (full % width + b * self.STARTS).tolist(), strict=True):
                phrase = self.phrases[p]
                score = sum(self.ratio(w, words[s + j]) for j, w in enumerate(phrase)) / len(phrase)
                if score >= self.threshold and (score, -s) > best.get(p, (0.0, -len(words) - 1)):
                    best[p] = (score, -s)
        return [(p, -back, -back + len(self.phrases[p]) - 1, score) for p, (score, back) in sorted(best.items())]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from ``first`` on, ``n`` of each."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


#: Bytes of words that are looked up together.
_TOGETHER = 4 << 20


def _some_documents(batch: pa.RecordBatch):
    """The batch in slices of whole documents of about so many bytes."""
    parts = max(1, -(-batch.nbytes // _TOGETHER))
    step = max(1, -(-batch.num_rows // parts))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def phrase_hits(elements: DataFrame, phrases: list[str], key: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """``(key, phrase, first, last, score)``: where each phrase's words best agree with as many consecutive words of the
    document, on average, the earliest of equal ones; no row below ``threshold``.

    The phrases are a stated list that every task holds; a document's words come together once, and are searched in Arrow batches."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    kind = elements.schema[key].dataType.simpleString()
    words = elements.select(key, "pos", T.words(F.col("text")).alias("words"))
    rows = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("lines"))

    def run(batches):
        index = PhraseIndex(phrases, threshold)
        for batch in batches:
            out = []
            for docs in _some_documents(batch):
                lines = docs.column(1)
                each = lines.flatten()
                pos, texts = each.field("pos").to_numpy(), each.field("words")
                per_line = texts.value_lengths().fill_null(0).to_numpy()
                coded = texts.flatten().dictionary_encode()
                known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                n, places, bounds = index.stand_for(known)
                first, of = np.cumsum(n) - n, np.repeat(pos, per_line)
                ends = np.concatenate([[0], np.cumsum(per_line)])[np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy())])]
                for k, a, b in zip(docs.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = code[a:b]
                    if n[own].any():
                        rows = _ranges(first[own], n[own])
                        found = index.hits([known[c] for c in own.tolist()], n[own], places[rows], bounds[rows])
                        out.extend((k, phrase, of[a + x], of[a + y], score) for phrase, x, y, score in found)
            if out:
                types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [key, "phrase", "first", "last", "score"])

    return rows.mapInArrow(run, f"`{key}` {kind}, phrase int, first int, last int, score double")


def _phrase_words(phrase: str) -> list[str]:
    import re

    return re.sub(r"[^\wÀ-ž\s-]", "", phrase.lower()).split()


def phrase_condition(elements: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``phrase_condition``: 30 on a Title that a phrase hits; else 10 on the nearest Title up to 3 below, or else up to 2 above; else 5 on
    the element itself.  Where several phrases score one element the last one stands."""
    w, title = _w(key), F.col("type") == "Title"
    near = F.coalesce(*[F.when(F.lead(title, k).over(w), F.lead("pos", k).over(w)) for k in (1, 2, 3)], *[F.when(F.lag(title, k).over(w), F.lag("pos", k).over(w)) for k in (1, 2)])
    target = F.when(title, F.struct(F.col("pos").alias("to"), F.lit(PHRASE_HIT).alias("score"))).when(near.isNotNull(), F.struct(near.alias("to"), F.lit(PHRASE_NEAR).alias("score"))).otherwise(
        F.struct(F.col("pos").alias("to"), F.lit(PHRASE_ELSE).alias("score"))
    )
    targets = elements.select(key, F.col("pos").alias("first"), target.alias("target"))
    given = hits.select(key, "phrase", "first").join(targets, [key, "first"]).select(key, F.col("target.to").alias("pos"), "phrase", F.col("target.score").alias("score"))
    last = given.groupBy(key, "pos").agg(F.max_by("score", "phrase").alias("phrases_condition"))
    return elements.join(last, [key, "pos"], "left").withColumn("phrases_condition", F.coalesce("phrases_condition", F.lit(0.0)))


CONDITIONS = ("title_condition", "token_condition", "first_listitem_condition", "phrases_condition")


def title_runs(scored: DataFrame, conditions: list[str], key: str = "doc_id") -> DataFrame:
    """In a run of Titles on one page the first has the greatest value of each condition, and the others 1; a lone Title is unchanged."""
    w, title = _w(key), F.col("type") == "Title"
    page = F.coalesce(F.col("page_number"), F.lit(-1))
    start = ~F.coalesce(title & (F.lag("type").over(w) == "Title") & (F.lag(page).over(w) == page), F.lit(False))
    d = scored.withColumn("island", F.sum(F.when(start, 1).otherwise(0)).over(w))
    run = Window.partitionBy(key, "island")
    d = d.withColumn("run_size", F.count(F.lit(1)).over(run)).withColumn("run_place", F.row_number().over(run.orderBy("pos")))
    several = title & (F.col("run_size") > 1)
    tops = {c: F.when(several & (F.col("run_place") == 1), F.max(c).over(run)).when(several, 1.0).otherwise(F.col(c)) for c in conditions}
    return d.withColumns(tops).drop("island", "run_size", "run_place")


def split_scores(elements: DataFrame, phrases: list[str] | None = None, config: SplitConfig | None = None, key: str = "doc_id") -> DataFrame:
    """``elements`` with ``score``: the conditions, null for phrases where no list is given, and their sum; the first element's
    sum is the greatest of the others and 1 more.  Elements: ``key, pos, type, text, token_size, page_number``."""
    c = config or SplitConfig()
    d = elements.withColumn("title_condition", title_condition(F.col("type")))
    d = token_condition(d, key, c.title_token_threshold)
    d = d.withColumn("first_listitem_condition", first_list_item(F.col("type"), key))
    names = list(CONDITIONS if phrases else CONDITIONS[:3])
    if phrases:
        d = phrase_condition(d, phrase_hits(elements, phrases, key), key)
    d = title_runs(d, names, key)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    d = d.withColumn("sum", total)
    top = F.max(F.when(F.col("pos") > 0, F.col("sum"))).over(Window.partitionBy(key))
    d = d.withColumn("sum", F.when(F.col("pos") == 0, F.coalesce(top + 1, F.col("sum"))).otherwise(F.col("sum")))
    score = F.struct(*names[:3], (F.col("phrases_condition") if phrases else F.lit(None).cast("double")).alias("phrases_condition"), "sum")
    return d.withColumn("score", score).drop(*names, "sum")
