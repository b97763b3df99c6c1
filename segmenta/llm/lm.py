"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model with Dirichlet smoothing over an additively smoothed unigram model::

    p(w)     = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    p(w | u) = (c(u w) + K * p(w)) / (c(u) + K)

As an automaton: a state for the empty history and one for every word (and the start of a text); a state has an arc for
every n-gram seen after its history, weighted log p(w | u); its failure arc leads to the root and is weighted
log K / (c(u) + K).  A text is read once from left to right: each token leads to its own state, by the arc if there is one,
or else by the failure arc and the root's arc; the weights are added up.

All texts are counted.  Documents are dealt into buckets by hash.  A bucket sends the distinct n-grams that it holds, as sorted
64-bit hashes with its own training counts, in one packed row for each range of hashes; each range adds up the counts of
all buckets and sends back to every bucket the sums that differ from the bucket's own, by their places among what it sent.  The bucket then scores its
documents over the automaton of just the n-grams that occur in it.  So no task, and not the driver, holds the model, and
a frequent n-gram costs a row's entry for each bucket at most.  Two n-grams with equal hashes would share a count; with ten
million of them the odds of one such pair are 1 in 300,000."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import bounded_batches, hashed_to, parts_for, text_bytes

ALPHA = 0.1
#: Weight of the unigram model in a history, in observations.
PRIOR = 500.0
#: Text bytes of a bucket, on average; buckets for each range of hashes.
BUCKET_BYTES, RANGE_BUCKETS = 16 << 20, 2
#: Words hashed once by a worker, before it starts anew.
MEMO_WORDS = 400_000
END, START = xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b"\n\n")  # no word holds a newline
CHUNK = 1 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _Hashes()


def token_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text followed by the end token; and tokens of each text.

    Words are runs of characters other than [\\x20\\x09-\\x0D], A-Z lower-cased; a null text has none."""
    parts, sizes, some, n = [], [], [], 0
    get = _HASHES.__getitem__
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        some.extend(map(get, words))
        some.append(END)
        sizes.append(len(words) + 1)
        n += len(words) + 1
        if len(some) >= CHUNK:
            parts.append(np.array(some, np.uint64))
            some = []
    parts.append(np.array(some, np.uint64))
    return np.concatenate(parts), np.array(sizes, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def histories(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; the start before a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[: len(sizes)]] = START
    return before


def pair_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return _mix(_mix(before) + tokens)


class Counted:
    """Sorted distinct keys, their counts in training documents, and the place of each occurrence."""

    def __init__(self, keys: np.ndarray, training: np.ndarray):
        self.keys, self.at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(self.at[training], minlength=len(self.keys)).astype(np.int64)

    def overlay(self, part: int, ranges: int, places: np.ndarray, counts: np.ndarray) -> None:
        """Replace counts; places are numbered from the first key of a range."""
        first = np.searchsorted(_ranges(self.keys, ranges), part)
        self.counts[first + places.astype(np.int64)] = counts


class Bucket:
    """The n-grams of some documents."""

    def __init__(self, texts, training: np.ndarray):
        self.tokens, self.sizes = token_hashes(texts)
        train = np.repeat(training, self.sizes)
        before = histories(self.tokens, self.sizes)
        # the start's count is that of training documents: it is a history, though never a token
        starts = np.full(len(self.sizes), START, np.uint64)
        self.words = Counted(np.concatenate([self.tokens, starts]), np.concatenate([train, training]))
        self.pairs = Counted(pair_hashes(before, self.tokens), train)
        self.before = before


class BackoffAutomaton:
    """The automaton over the n-grams of a bucket, with all documents' counts."""

    def __init__(self, b: Bucket, total: int, distinct: int, prior: float = PRIOR, alpha: float = ALPHA):
        n = len(b.tokens)
        self.root = np.log10((b.words.counts + alpha) / (total + alpha * (distinct + 1)))  # arc of the root, by word
        self.fail = np.log10(prior / (b.words.counts + prior))  # failure arc, by state
        state = np.empty(n, np.int64)  # the state in which each token is read: that of the token before
        state[1:] = b.words.at[: n - 1]
        first = np.concatenate([[0], np.cumsum(b.sizes)[:-1]]).astype(np.int64)[: len(b.sizes)]
        state[first] = b.words.at[n : n + len(b.sizes)]
        self.state, self.word, self.pair = state, b.words.at[:n], b.pairs.at
        self.first, self.sizes = first, b.sizes
        seen, c_history = b.pairs.counts[self.pair], b.words.counts[state]
        arc = np.log10((seen + prior * 10.0 ** self.root[self.word]) / (c_history + prior))
        self.weights = np.where(seen > 0, arc, self.fail[state] + self.root[self.word])

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each text: the model's weights, and the root's alone."""
        if not len(self.sizes):
            return np.zeros(0), np.zeros(0)
        return np.add.reduceat(self.weights, self.first), np.add.reduceat(self.root[self.word], self.first)


# -- packed rows
def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences of as few bytes as they need; counts likewise.  All first bytes stand together, then all second
    ones, and so on: the high ones are mostly zero, and the shuffle's compression makes little of them."""

    def narrow(x: np.ndarray) -> bytes:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()

    return narrow(np.diff(keys, prepend=np.uint64(0))), narrow(counts.astype(np.uint64))


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    def wide(raw: bytes) -> np.ndarray:
        width = raw[0]
        a = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
        out = np.zeros((a.shape[1], 8), np.uint8)
        out[:, :width] = a.T
        return out.view("<u8").ravel().astype(np.uint64)

    return np.cumsum(wide(keys), dtype=np.uint64), wide(counts).astype(np.int64)


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


PACKED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PACKED_SQL = "kind int, part int, bucket int, keys binary, counts binary"


def _packed(kind: int, c: Counted, ranges: int, bucket: int) -> list[tuple]:
    if not len(c.keys):
        return []
    r = _ranges(c.keys, ranges)
    cuts = np.flatnonzero(np.diff(r, prepend=r[:1] + np.uint64(1)))
    ends = np.append(cuts[1:], len(r))
    return [(kind, int(r[a]), bucket, *pack(c.keys[a:b], c.counts[a:b])) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(PACKED)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, PACKED, strict=True)], schema=PACKED)


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
    """Keys and summed counts of all packed rows of one range; and the rows."""
    rows = [(b, *unpack(k, c)) for b, k, c in zip(table["bucket"].to_pylist(), table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)]
    keys, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([r[2] for r in rows]).astype(np.float64), len(keys)).astype(np.int64), rows


def _training(table, name: str = "training") -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False).astype(bool) if isinstance(table, pa.RecordBatch) else table[name].to_numpy().astype(bool)


def totals(docs: DataFrame, ranges: int) -> tuple[int, int]:
    """Tokens, and distinct tokens, of the rows of ``text, training`` that are for training."""

    def run(rows):
        for batch in rows:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            texts = [x for x, t in zip(batch.column(0).to_pylist(), train, strict=True) if t]
            tokens, sizes = token_hashes(texts)
            yield from _table(_packed(0, Counted(tokens, np.ones(len(tokens), bool)), ranges, 0)).to_batches()

    def add(table):
        keys, counts, _ = _merge(table)
        return pa.table({"n": pa.array([int(counts.sum())]), "v": pa.array([len(keys)])})

    packed = docs.select("text", "training").where("training").mapInArrow(run, PACKED_SQL)
    summed = packed.groupBy("part").applyInArrow(add, "n long, v long")
    n, v = summed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return int(n), int(v)


def score(docs: DataFrame, training, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, prior: float = PRIOR) -> DataFrame:
    """``(key, training, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``training``: a boolean column expression; rows where it isn't true are scored but not learned from.  A null or empty text is
    its end token.  Null keys and repeated rows are kept, and repeated training rows count as often as they come.  With no training
    rows at all every token has the one probability of an unknown token."""
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    parts = parts_for(text_bytes(d, "text"), bucket_bytes, spark.sparkContext.defaultParallelism)
    ranges = parts_for(parts, RANGE_BUCKETS, min(parts, spark.sparkContext.defaultParallelism))
    total, distinct = totals(d, ranges)
    dealt = d.withColumn("bucket", hashed_to(F.pmod(F.xxhash64("key", "text"), F.lit(parts)))).repartition(parts, "bucket")

    def count(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([])
        b, bucket = Bucket(_texts(table), _training(table)), table["bucket"][0].as_py()
        return _table(_packed(0, b.words, ranges, bucket) + _packed(1, b.pairs, ranges, bucket))

    def answer(table: pa.Table) -> pa.Table:
        keys, counts, rows = _merge(table)
        kind, part, out = table["kind"][0].as_py(), table["part"][0].as_py(), []
        for bucket, own, own_counts in rows:
            all_counts = counts[np.searchsorted(keys, own)]
            other = np.flatnonzero(all_counts != own_counts)
            if len(other):
                out.append((kind, part, bucket, *pack(other.astype(np.uint64), all_counts[other])))
        return _table(out)

    kind = d.schema["key"].dataType.simpleString()
    schema = f"key {kind}, training boolean, n_tokens long, n_known long, base_score double, score double"

    def traverse(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        b = Bucket(_texts(docs_), _training(docs_))
        for k, part, places, counts in zip(*(answers[c].to_pylist() for c in ("kind", "part", "keys", "counts")), strict=True):
            (b.pairs if k else b.words).overlay(part, ranges, *unpack(places, counts))
        a = BackoffAutomaton(b, total, distinct, prior)
        model, base = a.scores()
        known = np.add.reduceat((b.words.counts[a.word] > 0).astype(np.int64), a.first) if len(a.first) else np.zeros(0, np.int64)
        return pa.table({"key": docs_["key"], "training": docs_["training"], "n_tokens": pa.array(b.sizes), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(model)})

    counts = dealt.groupBy("bucket").applyInArrow(count, PACKED_SQL)
    answers = counts.groupBy("kind", "part").applyInArrow(answer, PACKED_SQL)
    found = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(traverse, schema)
    return found.select(F.col("key").alias(key), "training", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _texts(table: pa.Table):
    for chunk in table["text"].chunks:
        for x in chunk:
            yield x.as_py()


def held_out(key: str = "doc_id", folds: int = 10, fold: int = 0):
    """Whether crc32 of the key as text, modulo ``folds``, is ``fold``; false for a null key."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def scored(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    found = score(docs, ~held_out())
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
