"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter over the character n-grams that are usual in it.  The filters are bit-sliced: position ``p``
of all filters is one word whose bit ``l`` belongs to language ``l``.  One look-up of an n-gram reads a word at
each hash position and ANDs them, and so returns all languages that contain the n-gram.  The set bits
are counted per language over the text; the count is corrected for the filter's false-positive rate, and the
language with the most n-grams decides.

The filters are fitted on a bounded sample of labelled rows (``docs_per_lang``, by a hash of the key); n-grams are counted by
documents, in the cluster."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm.common import bounded_batches

N = 5
#: Labelled documents for each language that the filters are fitted on: a bounded sample.
DOCS_PER_LANG = 2000
#: An n-gram is usual in a language if this share of its documents has it, and at least this share of
#: what it has in the language where it is most usual.
MIN_SHARE, MIN_RATIO = 0.003, 0.1
#: Documents without an n-gram that every language is given beside its own, so that a few documents can't make an n-gram its property.
PRIOR_DOCS = 50
#: Bits of a filter and hash positions.
BITS, HASHES = 1 << 20, 3
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, other characters as spaces, a space around each; and where each ends."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 2 for t in low])
    a = np.frombuffer("".join([f" {t} " for t in low]).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[a], a, 32), ends


def _grams(a: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n-gram at every position."""
    size = max(0, len(a) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + a[k : k + size].astype(np.uint64)
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _informative(a: np.ndarray, n: int) -> np.ndarray:
    """Positions whose n-gram has a letter."""
    sums = np.concatenate([[0], np.cumsum(a != 32)])
    return sums[n:] > sums[:-n] if len(a) >= n else np.zeros(0, bool)


def _positions(h: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    """The hash positions of an n-gram (double hashing)."""
    a, b = (h >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.int64) | 1
    return [(a + k * b) & (bits - 1) for k in range(hashes)]


@dataclass
class Filters:
    """``slices[p]``: bit ``l`` set if position ``p`` of language ``l`` is set; a row of several words beyond 64 languages."""

    langs: list[str]
    n: int
    hashes: int
    slices: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, langs: list[str], grams: list[np.ndarray], n: int = N, bits: int = BITS, hashes: int = HASHES) -> Filters:
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        slices = np.zeros((bits, max(1, -(-len(langs) // 64))), kind)
        fill = np.zeros(len(langs))
        for k, g in enumerate(grams):
            at = np.unique(np.concatenate(_positions(g, bits, hashes)))
            slices[at, k // 64] |= kind(1 << k % 64)
            fill[k] = len(at) / bits
        return cls(langs, n, hashes, slices, fill**hashes)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the bit mask of the languages that contain it, in one word or several."""
        at = _positions(h, len(self.slices), self.hashes)
        out = self.slices[at[0]]
        for p in at[1:]:
            out = out & self.slices[p]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and how many of them each language contains (texts x languages)."""
        a, ends = _codes(texts)
        keep = np.flatnonzero(_informative(a, self.n))
        masks = self.masks(_grams(a, self.n)[keep])
        of = np.searchsorted(ends, keep, "right")  # an n-gram belongs to the text in which it begins
        inside = keep + self.n <= ends[of] if len(keep) else np.zeros(0, bool)
        of, masks = of[inside], masks[inside]
        total = np.bincount(of, minlength=len(texts))
        one = masks.dtype.type(1)
        has = lambda k: (masks[:, k // 64] >> masks.dtype.type(k % 64)) & one == 1
        return total, np.stack([np.bincount(of[has(k)], minlength=len(texts)) for k in range(len(self.langs))], axis=1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: the share of its n-grams that the language contains, corrected for false
        positives, between 0 and 1.  Ties go to the first language by name.  ``und`` and 0 if there is no letter."""
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not known or not self.langs:
            return out
        total, hits = self.counts([texts[k] for k in known])
        share = (hits - total[:, None] * self.false_rate) / (np.maximum(total, 1)[:, None] * (1 - self.false_rate))
        best = share.argmax(axis=1)
        for k, b, s in zip(known, best.tolist(), share[np.arange(len(known)), best].tolist(), strict=True):
            out[k] = (self.langs[b], min(1.0, max(0.0, s)))
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, n: int = N) -> Filters:
    """Fit on rows with a language; rows with null or letterless texts teach nothing.

    The sample takes each language's rows with the smallest hashes of key and text: about ``docs_per_lang`` of
    them, all where there are fewer.  The key serves for the sample alone."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(key).cast("string").alias("k"))
    # one row for each language
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Filters.build([], [], n)
    limit = F.create_map(*[x for k, c in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / c)))])
    u = F.pmod(F.xxhash64(F.lit("lang-sample"), "k"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(u < F.try_element_at(limit, F.col("lang"))).select("lang", "text")

    def run(batches):
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    a, _ = _codes([t])
                    found.setdefault(name, []).append(np.unique(_grams(a, n)[_informative(a, n)]))
            for name, parts in found.items():
                g, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "g", "c"])

    counted = sample.mapInArrow(run, "lang string, g long, c long").groupBy("g", "lang").agg(F.sum("c").alias("c"))
    docs = {k: min(c, docs_per_lang) for k, c in sizes.items()}
    of = F.create_map(*[x for k, c in docs.items() for x in (F.lit(k), F.lit(float(c)))])
    n_docs = F.try_element_at(of, F.col("lang"))
    counted = counted.withColumn("share", F.col("c") / (n_docs + PRIOR_DOCS)).where((F.col("share") >= MIN_SHARE) & ((F.col("c") >= 2) | (n_docs < 2 / MIN_SHARE)))
    top = counted.groupBy("g").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("all"))
    usual = top.select("g", F.explode("all").alias("x"), "top").where(F.col("x.share") >= MIN_RATIO * F.col("top")).select("g", F.col("x.lang").alias("lang"))
    langs = sorted(sizes)
    got = usual.toPandas()  # bounded: n-grams in at least MIN_SHARE of a bounded sample
    return Filters.build(langs, [got["g"].to_numpy(np.int64)[(got["lang"] == k).to_numpy()].view(np.uint64) for k in langs], n)


def predict(docs: DataFrame, filters: Filters, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its score; columns of these names are replaced.

    Nothing but the text is looked at.  No shuffle; the filters (a fixed number of bytes) go to every task."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(filters)
    kept = [c for c in docs.columns if c not in (pred, score)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{pred}` string", f"`{score}` double"])

    def run(batches):
        f = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found, part, size = [], [], 0
            for k, t in enumerate(texts):  # some at a time: arrays are many times the text
                part.append(t)
                size += len(t or "")
                if size >= 1 << 18 or k == len(texts) - 1:
                    found.extend(f.predict(part))
                    part, size = [], 0
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *made], [*kept, pred, score])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the key as text, modulo ``folds``, is ``fold``; false for a null key."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's rows: learn from the rows that aren't held out, predict all.

    Rows with a null id are learned from, as they are in no fold; repeated rows are learned from and predicted as often as they come; texts that are null,
    empty or without a letter are ``und``; with no labelled text every text is ``und``; an empty table gives no rows."""
    filters = fit(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
