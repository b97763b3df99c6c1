"""Line dedup: lines found in many documents lose all their places.

Lines are exploded, normalised and hashed (128 bits), documents are counted per hash after
a count within each batch, and hashes at or over the threshold are the frequent lines.
Reassembly goes by position.  Where the frequent hashes are few (a checked number of bytes)
they go to every task; otherwise the hashed lines are joined with them, keyed by the hash of
their text, and only the dropped positions come back to the texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import bounded_batches, materialise

#: Distinct lines counted in a task before they are handed on.
FLUSH = 1 << 18
#: Bytes of frequent hashes (16 each) up to which they are sent to every task.
BROADCAST_BYTES = 16 << 20


def line_key(line: bytes) -> bytes:
    """Stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; bytes methods do exactly that."""
    return line.strip().lower()


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``(h, n_docs)``: the 16-byte hashes of the keys found in at least ``min_docs`` documents.

    A document is a row; a line that it repeats counts once."""

    def run(rows):
        counts: Counter = Counter()

        def hand_on():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(counts.values()), pa.int64())], ["h", "n"])
            counts.clear()
            return out

        for batch in rows:
            for value in batch.column(0):
                keys = {line_key(x) for x in _split(value.as_py())}
                counts.update([_digest(k) for k in keys if _long_enough(k, min_chars)])
                if len(counts) >= FLUSH:
                    yield hand_on()
        if counts:
            yield hand_on()

    per_task = docs.select(F.col(text).cast("string")).mapInArrow(run, "h binary, n long")
    return per_task.groupBy("h").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _drop(text: str | None, is_frequent, min_chars: int) -> tuple[int, int, str | None]:
    lines = _split(text)
    kept = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and is_frequent(_digest(k)))]
    if len(kept) == len(lines):
        return len(lines), 0, text
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")


def drop_frequent_lines(
    docs: DataFrame, text: str = "text", out: str = "kept", min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES, counts: tuple[str, str] = ("n_lines", "n_dropped")
) -> DataFrame:
    """All rows and columns of ``docs``, with ``out`` (the kept lines joined by newline) and ``counts`` (lines before, and
    dropped); columns of these names are replaced.  ``out`` may be ``text`` itself.

    A null or empty text is one empty line: ``n_lines`` 1, kept as it is.  Repeated rows are so many
    documents.  An empty table gives no rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    frequent = materialise(frequent_lines(docs, text, min_docs, min_chars).select("h"), "line-hashes")
    if frequent.count() * 16 <= broadcast_bytes:
        return _drop_by_set(docs, [bytes(r["h"]) for r in frequent.collect()], spark, text, out, min_chars, counts)
    return _drop_by_join(docs, frequent, text, out, min_chars, counts)


def _with(docs: DataFrame, added: dict[str, str], run) -> DataFrame:
    """``run(batch)`` gives the added columns of a batch; columns of the same name are replaced."""
    kept = [c for c in docs.columns if c not in added]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"`{c}` {t}" for c, t in added.items())])

    def each(rows):
        for batch in rows:
            made = run(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *made], [*kept, *added])

    return docs.mapInArrow(each, schema)


def _drop_by_set(docs, frequent, spark, text, out, min_chars, counts):
    sent = spark.sparkContext.broadcast(frozenset(frequent))

    def run(batch):
        known = sent.value
        found = [_drop(x.as_py(), known.__contains__, min_chars) for x in batch.column(batch.schema.get_field_index(text))]
        return [pa.array([x[2] for x in found], pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())]

    return _with(docs, {out: "string", counts[0]: "long", counts[1]: "long"}, run)


def _drop_by_join(docs, frequent, text, out, min_chars, counts):
    def explode(rows):
        for batch in rows:
            of, pos, hashes = [], [], []
            for value in batch.column(0):
                lines = _split(value.as_py())
                whole = hashlib.blake2b(b"\n".join(lines), digest_size=16).digest()
                for k, x in enumerate(lines):
                    if _long_enough(key := line_key(x), min_chars):
                        of.append(whole), pos.append(k), hashes.append(_digest(key))
                if len(of) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), pa.array(pos, pa.int32()), pa.array(hashes, pa.binary())], ["of", "pos", "h"])
                    of, pos, hashes = [], [], []
            if of:
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), pa.array(pos, pa.int32()), pa.array(hashes, pa.binary())], ["of", "pos", "h"])

    lines = docs.select(F.col(text).cast("string")).mapInArrow(explode, "of binary, pos int, h binary")
    dropped = lines.join(frequent, "h", "left_semi").distinct().groupBy("of").agg(F.collect_set("pos").alias("__drop"))

    def of(batch):
        return [pa.array([hashlib.blake2b(b"\n".join(_split(x.as_py())), digest_size=16).digest() for x in batch.column(batch.schema.get_field_index(text))], pa.binary())]

    joined = _with(docs, {"__of": "binary"}, of).join(dropped.withColumnRenamed("of", "__of"), "__of", "left").drop("__of")

    def run(batch):
        kept, n_lines, n_dropped = [], [], []
        for value, gone in zip(batch.column(batch.schema.get_field_index(text)), batch.column(batch.schema.get_field_index("__drop")), strict=True):
            lines = _split(value.as_py())
            drop = set(gone.as_py() or ())
            kept.append(value.as_py() if not drop else b"\n".join([x for k, x in enumerate(lines) if k not in drop]).decode("utf-8", "surrogatepass"))
            n_lines.append(len(lines)), n_dropped.append(len(drop))
        return [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

    return _with(joined, {out: "string", counts[0]: "long", counts[1]: "long"}, run).drop("__drop")


def digests(deduped: DataFrame, key: str = "doc_id", out: str = "kept") -> DataFrame:
    return deduped.select(F.col(key).alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce(out, F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def oracle_sql(min_docs: int = 10, min_chars: int = 1) -> str:
    """DuckDB SQL for the query's rows (``doc_id`` unique)."""
    return rf"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
