"""Token ids as binary files with keyed access.

A store is a folder of shards and a manifest.  Documents are laid out in ascending key order,
shard after shard; a task writes the shards of a key range one after the other, and closes each at a number of bytes.  A shard is one file:

    magic "SEGTOK1\\n" | header length, uint32 | header, JSON | sections
    payload       ids, uint16 if every id of the vocabulary fits, else uint32, little-endian
    offsets       uint64, one more than documents: where each document's ids begin
    order         uint32: slot of the minimal perfect hash to document number
    fingerprints  uint32 by slot, of the key
    keys          int64 by document, and whether the key is null, uint8
    bits, ranks   the minimal perfect hash: its levels' bit arrays, and ones before each word

The minimal perfect hash has levels of bit arrays.  A key hashes to a bit of the first level; if it
is alone there the bit is set, and its slot is the number of ones before; keys that collide go
to the next level.  A look-up takes a constant expected number of probes, then one comparison of the stored
fingerprint, which turns away keys that aren't in the shard.

Files are written through pyarrow's file systems to any shared folder (file, hdfs, s3, ...): first under a
name of the attempt, then moved, so a repeated task leaves one whole file with the same bytes."""

from __future__ import annotations

import functools
import json
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmenta.llm.bpe import Memo, byte_alphabet
from segmenta.llm.common import bounded_batches, fresh_path, parts_for, text_bytes, tidied

MAGIC = b"SEGTOK1\n"
#: Text bytes in a shard, on average.
SHARD_BYTES = 16 << 20
#: Bits of a level for each key, and levels of random placement (then the rest is listed).
GAMMA, LEVELS = 2.0, 48
#: Bytes of remembered pieces that a worker holds (twice as many at most).
MEMO_BYTES = 96 << 20
#: Shards of one group of running sums.
RUN = 4096


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):  # file:/x and file:///x
        path = "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


# -- minimal perfect hash
def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_keys(keys: np.ndarray, nulls: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """64 bits of a key, whether it is null, and how many equal keys come before it."""
    h = mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return mix64(h ^ (repeats.astype(np.uint64) << np.uint64(1)) ^ nulls.astype(np.uint64))


def _spot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix64(h + np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) % np.uint64(size)


class PerfectHash:
    """Levels of bit arrays over 64-bit hashes that are all different."""

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], h
        while len(left):
            if len(sizes) >= LEVELS:
                raise ValueError("hashes repeat: no perfect hash over them")
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _spot(left, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        bits = np.concatenate(words) if words else np.empty(0, np.uint64)
        ranks = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
        return cls(sizes, bits, ranks)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where no level holds it."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = _spot(h[open_], level, size).astype(np.int64) + self.starts[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[found]] = (self.ranks[at >> 6] + below)[found]
            open_ = open_[~found]
        return out


# -- shards
def repeats_of(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """For sorted keys: how many equal keys come just before each."""
    n = len(keys)
    if not n:
        return np.empty(0, np.int64)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.arange(n) - first


def write_shard(path: str, keys: np.ndarray, nulls: np.ndarray, counts: np.ndarray, payload: list[bytes], width: int) -> None:
    h = hashed_keys(keys, nulls, repeats_of(keys, nulls))
    mph = PerfectHash.build(h)
    slots = mph.slots(h)
    order, prints = np.empty(len(h), np.uint32), np.empty(len(h), np.uint32)
    order[slots], prints[slots] = np.arange(len(h)), (h >> np.uint64(32)).astype(np.uint32)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
    sections = {"offsets": offsets, "order": order, "fingerprints": prints, "keys": keys.astype(np.int64), "nulls": nulls.astype(np.uint8), "bits": mph.bits, "ranks": mph.ranks}
    head = {"width": width, "documents": len(keys), "ids": int(offsets[-1]), "sizes": mph.sizes, "sections": {k: [v.nbytes, v.dtype.str] for k, v in sections.items()}}
    raw = json.dumps(head).encode()
    fs, at = filesystem(path)
    attempt = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(attempt) as out:
        out.write(MAGIC + len(raw).to_bytes(4, "little") + raw)
        for part in payload:
            out.write(part)
        for v in sections.values():
            out.write(v.astype(v.dtype.newbyteorder("<")).tobytes())
    fs.move(attempt, at)


class Shard:
    """A shard opened for keyed access; its payload is read a document at a time."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{path}: not a token shard")
        self.head = json.loads(self.file.read(int.from_bytes(self.file.read(4), "little")))
        self.base, self.width = self.file.tell(), self.head["width"]
        at, got = self.base + self.head["ids"] * self.width, {}
        for name, (size, kind) in self.head["sections"].items():
            got[name] = np.frombuffer(self.file.read_at(size, at), kind)
            at += size
        self.offsets, self.order, self.prints, self.keys, self.nulls = (got[k] for k in ("offsets", "order", "fingerprints", "keys", "nulls"))
        self.mph = PerfectHash(self.head["sizes"], got["bits"], got["ranks"])

    def find(self, keys: np.ndarray, nulls: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Document numbers of keys (the ``repeats``-th of equal keys); -1 for keys that aren't here."""
        h = hashed_keys(keys, nulls, repeats)
        slots = self.mph.slots(h)
        found = slots >= 0
        found[found] = self.prints[slots[found]] == (h[found] >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(h), -1, np.int64)
        out[found] = self.order[slots[found]]
        return out

    def ids(self, number: int) -> np.ndarray:
        a, b = int(self.offsets[number]), int(self.offsets[number + 1])
        raw = self.file.read_at((b - a) * self.width, self.base + a * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def get(self, key: int | None, repeat: int = 0) -> np.ndarray | None:
        number = int(self.find(np.array([key or 0]), np.array([key is None]), np.array([repeat]))[0])
        return None if number < 0 else self.ids(number)


# -- encoding with the library
class _NotAlone(Exception):
    """A piece whose ids depend on what stands before it."""


class CachedEncoder:
    """The library's ids, remembered by piece of text.

    What the byte-level pattern makes of a text at some place depends only on what comes after it, and no match goes from
    another character into a single space with text behind it.  So the text is cut before such spaces, and a piece
    that is new is cut by the pattern into pre-tokens, which the library's model encodes.  Where a space is followed by white space the
    text is cut by the pattern alone.  Texts with special tokens, or with
    characters that only one of two regular expression engines takes for white space, are encoded whole, and pieces beyond Latin
    letters, where the engines' tables may differ in age, as one.  So are all texts if the file isn't plain byte-level BPE with that pattern."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    PIECES = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
    ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
    FAR = re.compile("[^\x00-\u024f]")
    STOPS = ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        with open(path, encoding="utf-8") as f:
            self.plain = self.is_plain(json.load(f))
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.width = 2 if self.t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.code = "H" if self.width == 2 else "I"
        self.pattern = regex.compile(self.PATTERN)
        self.bytes = byte_alphabet()
        self.space = self.bytes[ord(" ")]
        self.model = self.t.model
        self.pieces = Memo(self._piece, MEMO_BYTES // 8)
        self.led = Memo(self._led, MEMO_BYTES)

    @staticmethod
    def is_plain(spec: dict) -> bool:
        """Whether texts may be cut into pieces and pre-tokens that are encoded alone, by this class's pattern."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        levels = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        words = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback"))
        return bool(levels and words and not spec.get("normalizer"))

    def _whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _token(self, text: str) -> bytes:
        """A pre-token: its bytes as characters, merged by the library's model."""
        if text.isascii() and text[1:].isalnum():  # such bytes stand for themselves, but for the space
            spelled = self.space + text[1:] if text[0] == " " else text
        else:
            spelled = "".join([self.bytes[b] for b in text.encode("utf-8")])
        return array(self.code, [x.id for x in self.model.tokenize(spelled)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if self.FAR.search(piece):
            return self._whole(piece)
        return b"".join(map(self._token, self.pattern.findall(piece)))

    def _led(self, rest: str) -> bytes:
        """A piece by what follows its space; most are a word, or a word and a stop."""
        if not rest or rest[0].isspace():
            raise _NotAlone
        if rest.isalpha():
            if rest.isascii() or not self.FAR.search(rest):
                return self._token(" " + rest)
        elif rest[-1] in self.STOPS and rest[:-1].isalpha():
            if rest.isascii() or not self.FAR.search(rest):
                return self.led[rest[:-1]] + self.pieces[rest[-1]]
        return self._piece(" " + rest)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or any(x in text for x in self.special) or (not text.isprintable() and self.ODD.search(text)):
            return self._whole(text)
        first, *rest = text.split(" ")
        try:
            return (self._piece(first) if first else b"") + b"".join(map(self.led.__getitem__, rest))
        except _NotAlone:
            return b"".join(map(self.pieces.__getitem__, self.PIECES.findall(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task's cores are Spark's
    return CachedEncoder(path)


# -- the operator
MANIFEST = "part int, shard int, file string, documents long, ids long"


def write_store(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int | None = None, shard_bytes: int = SHARD_BYTES) -> str:
    """Encode all texts and write the store; returns its folder.

    Documents are range-partitioned by key and sorted (null keys first; equal keys by a hash of their texts, so that reruns
    agree); each partition is a run of shards, each closed when its ids and keys reach ``shard_bytes``, so a task holds one shard however long
    its texts are.  ``end_id`` is appended to every document.  Null and
    empty texts have no ids but that.  The key is an integer.  The manifest is a small Parquet table: a row for each shard."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or fresh_path(spark, "token-store")
    fs, at = filesystem(folder)
    fs.create_dir(f"{at}/shards", recursive=True)
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shards = parts_for(text_bytes(d, "text"), shard_bytes)

    def run(rows):
        from pyspark import TaskContext

        encode, number = encoder(tokenizer_path), 0
        end = b"" if end_id is None else int(end_id).to_bytes(encode.width, "little")
        keys, nulls, counts, payload, size = [], [], [], [], 0

        def closed():
            nonlocal number, size
            part = TaskContext.get().partitionId()
            name = f"shards/{part:08d}-{number:06d}.tok"
            counted = np.array(counts, np.int64)
            write_shard(f"{folder}/{name}", np.array(keys, np.int64), np.array(nulls, bool), counted, payload, encode.width)
            row = {"part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "file": [name], "documents": [len(keys)], "ids": [int(counted.sum())]}
            for x in (keys, nulls, counts, payload):
                x.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_pydict(row)

        for batch in rows:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py()) + end
                keys.append(key or 0), nulls.append(key is None), counts.append(len(ids) // encode.width), payload.append(ids)
                size += len(ids) + 16
                if size >= shard_bytes:
                    yield closed()
        if keys:
            yield closed()

    ordered = d.repartitionByRange(shards, F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(lambda rows: tidied(run(rows)), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, start, n_ids, ids binary)`` of every document, read from the files through their index.

    ``ids`` are little-endian uint32; ``start`` counts the ids of all documents before.  A shard is one task."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("run", F.floor(F.col("part") / RUN))
    before = manifest.groupBy("run").agg(F.sum("ids").alias("n"))  # one row for thousands of shards
    before = before.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("run").orderBy("part", "shard")) - F.col("ids")
    listed = manifest.withColumn("inside", inside).join(before, "run").select("file", (F.col("before") + F.col("inside")).alias("start"))
    listed = listed.repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(f"{folder}/{file}")
                repeats = repeats_of(shard.keys, shard.nulls.astype(bool))
                numbers = shard.find(shard.keys, shard.nulls, repeats)  # keyed access, as a reader with a list of keys has it
                for at in range(0, len(numbers), 512):
                    part = numbers[at : at + 512]
                    keys = pa.array(shard.keys[at : at + 512], mask=shard.nulls[at : at + 512].astype(bool))
                    ids = [shard.ids(int(k)).tobytes() for k in part]
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(start + shard.offsets[part].astype(np.int64)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "start", "n_ids", "ids"]
                    )

    return listed.mapInArrow(lambda rows: tidied(run(rows)), "key long, start long, n_ids long, ids binary")


class TokenStore:
    """Keyed access from one process: the key's shard by its key range, then the shard's perfect hash."""

    def __init__(self, folder: str):
        fs, at = filesystem(folder)
        import pyarrow.dataset as ds

        rows = ds.dataset(f"{at}/manifest", filesystem=fs, format="parquet").to_table().sort_by([("part", "ascending"), ("shard", "ascending")]).to_pylist()
        self.paths = [f"{folder}/{r['file']}" for r in rows]

    @functools.lru_cache(maxsize=64)
    def _shard(self, k: int) -> Shard:
        return Shard(self.paths[k])

    def get(self, key: int | None, repeat: int = 0) -> np.ndarray | None:
        lo, hi = 0, len(self.paths) - 1
        while lo < hi:  # the last shard that begins at or before the key
            mid = (lo + hi + 1) // 2
            s = self._shard(mid)
            lo, hi = (mid, hi) if key is not None and (s.nulls[0] or s.keys[0] <= key) else (lo, mid - 1)
        while lo > 0 and key is not None and not self._shard(lo).nulls[0] and self._shard(lo).keys[0] == key:
            lo -= 1  # equal keys may begin in a shard before
        for k in range(lo, len(self.paths)):
            s = self._shard(k)
            if (n := self._count(s, key)) > repeat:
                return s.get(key, repeat)
            repeat -= n
            if key is not None and len(s.keys) and not s.nulls[-1] and s.keys[-1] > key:
                return None
        return None

    @staticmethod
    def _count(s: Shard, key: int | None) -> int:
        nulls = s.nulls.astype(bool)
        return int(nulls.sum()) if key is None else int(np.searchsorted(s.keys[~nulls], key, "right") - np.searchsorted(s.keys[~nulls], key, "left"))


def digests(store: DataFrame) -> DataFrame:
    return store.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
