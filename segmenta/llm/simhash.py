"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64 bits.  Distinct fingerprints are laid out in tiles by population
count; two tiles are compared (numpy exclusive-or and bit counts) only if their counts
differ by no more than the radius, as the bit count of an exclusive-or is at least that
difference.  Inside a tile pair, of the radius + 1 parts that the 64 bits fall into, two near fingerprints have
at least one in common: only fingerprints with an equal part are compared.  Where so many have equal parts that this saves
little, all are, and the bound by counts, on the four 16-bit quarters, skips blocks.
Every tile pair is its own group, so work spreads over tasks however the fingerprints are
distributed; a tile pair returns spanning stars, never its pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import bounded_batches, materialise, parts_for
from segmenta.llm.components import connected_components, hook

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints in a tile, and comparisons that a task is given.
TILE = 8192
TASK_COMPARISONS = 1 << 31
BLOCK = 256
#: Pairs that are looked at together; equal parts are used if they leave fewer pairs than one in so many.
PAIRS, SAVING = 1 << 20, 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a text; zero if it is null or has no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII white space and A-Z only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    return int(np.packbits(2 * bit_sums(h) > len(h), bitorder="little").view(np.uint64)[0])


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 256):
        part = np.unpackbits(h[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        if whole:  # a byte can't overflow within 255 rows
            total += part[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += part[whole:].sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(key, fp)`` for every row; ``fp`` is the fingerprint as a signed long.

    Null keys and repeated rows are kept; other columns are not looked at.  No shuffle."""

    def run(rows):
        for batch in rows:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long")
    return made.select(F.col("key").alias(key), "fp")


# -- comparison of two tiles
def _laid_out(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordered by the counts of the quarters; and the least and largest counts of each block."""
    quarters = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(quarters.T[::-1])
    quarters, at = quarters[order], np.arange(0, len(fps), BLOCK)
    return fps[order], np.minimum.reduceat(quarters, at), np.maximum.reduceat(quarters, at)


def _equal_parts(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None:
    """For each of radius + 1 parts of the bits: how the fingerprints of ``b`` are ordered by it, and for each of ``a`` where those with its
    part begin and how many they are, as ``(rows of a, order, first, count)``; None if they are too many."""
    cuts, found, pairs = np.linspace(0, 64, radius + 2).astype(int), [], 0
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = lambda x: (x >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)  # noqa: E731, B023
        of = part(b)
        order = np.argsort(of, kind="stable")
        first, last = (np.searchsorted(of[order], part(a), side) for side in ("left", "right"))
        rows = np.flatnonzero(last > first)
        pairs += int((last - first).sum())
        if pairs * SAVING > len(a) * len(b):
            return None
        found.append((rows, order, first[rows], (last - first)[rows]))
    return found


def _by_parts(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray] | None:
    """``stars`` over fingerprints with an equal part, or None where these are too many."""
    own = b is None
    other, shift = (a, 0) if own else (b, len(a))
    if radius > 15 or (parts := _equal_parts(a, other, radius)) is None:
        return None
    values = a if own else np.concatenate([a, b])
    label = np.arange(len(values))
    for rows, order, first, count in parts:
        if not len(rows):
            continue
        cut = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + PAIRS, PAIRS))
        for x, y in zip(cut[:-1].tolist(), [*cut[1:-1].tolist(), len(rows)], strict=True):
            n = count[x:y]
            i = np.repeat(rows[x:y], n)
            j = order[np.arange(n.sum()) + np.repeat(first[x:y] - (np.cumsum(n) - n), n)]
            hit = np.bitwise_count(a[i] ^ other[j]) <= radius
            if own:
                hit &= i < j
            hook(label, i[hit], j[hit] + shift)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[label[moved]], values[moved]


def stars(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(root, member)`` that join what is linked within ``a`` (``b`` None) or between ``a`` and ``b``."""
    if (found := _by_parts(a, b, radius)) is not None:
        return found
    a, low_a, high_a = _laid_out(a)
    own = b is None
    b, low_b, high_b = (a, low_a, high_a) if own else _laid_out(b)
    values = a if own else np.concatenate([a, b])
    label, shift = np.arange(len(values)), 0 if own else len(a)
    for k in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_a[k] - high_b, low_b - high_a[k])).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if own:
            near = near[near >= k]
        if not len(near):
            continue
        cols = (near[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        cols = cols[cols < len(b)]
        hit = np.bitwise_count(a[k * BLOCK : (k + 1) * BLOCK, None] ^ b[cols]) <= radius
        i, j = np.nonzero(hit)
        hook(label, i + k * BLOCK, cols[j] + shift)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[label[moved]], values[moved]


def link(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` over the distinct values of the column ``fp`` whose components are those of
    all pairs within ``radius``.  Nulls link with nothing.

    What goes to the driver: one count for each of the 65 population counts."""
    spark = fps.sparkSession
    counted = materialise(fps.where("fp is not null").select("fp").distinct().withColumn("pc", F.bit_count("fp")), "simhash-distinct")
    counts = {r["pc"]: r["count"] for r in counted.groupBy("pc").count().collect()}
    tiles = [parts_for(counts.get(p, 0), tile, 0) for p in range(65)]
    compared = sum(counts.get(p, 0) * counts.get(q, 0) for p in range(65) for q in range(p, min(64, p + radius) + 1))
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    n_tiles = F.array(*[F.lit(n) for n in tiles])
    made = (
        counted.withColumn("tile", F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), F.get(n_tiles, F.col("pc")))).cast("int"))
        .groupBy("pc", "tile")
        .agg(F.collect_list("fp").alias("fps"))
    )

    def others(low, high):
        """All tiles of the population counts from low to high."""
        per = F.transform(
            F.sequence(low, high),
            lambda p: F.when(F.get(n_tiles, p) > 0, F.transform(F.sequence(F.lit(0), F.get(n_tiles, p) - 1), lambda t: F.struct(p.alias("pc"), t.alias("tile")))).otherwise(
                F.array().cast("array<struct<pc:int,tile:int>>")
            ),
        )
        return F.flatten(per)

    me = F.struct(F.col("pc").cast("int").alias("pc"), F.col("tile").alias("tile"))
    pc = F.col("pc").cast("int")
    up = made.select(me.alias("p"), F.explode(F.filter(others(pc, F.least(F.lit(64), pc + radius)), lambda o: o >= me)).alias("q"), F.lit(0).alias("side"), "fps")
    down = made.select(F.explode(F.filter(others(F.greatest(F.lit(0), pc - radius), pc), lambda o: o < me)).alias("p"), me.alias("q"), F.lit(1).alias("side"), "fps")
    pairs = up.unionByName(down).repartition(parts_for(compared, TASK_COMPARISONS, spark.sparkContext.defaultParallelism), "p", "q")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_pylist()
        got = {s: table.column("fps")[k].values.to_numpy().view(np.uint64) for k, s in enumerate(side)}
        a, b = stars(got[0], got.get(1), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return pairs.groupBy("p", "q").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS, tile: int = TILE) -> DataFrame:
    """``(key, fp, component_id)`` for every row; the component is the smallest key reachable by links.

    Rows with equal fingerprints are linked, texts without words among them.  Null keys count as
    no key: their component is the smallest key that isn't null, or null.  Repeated rows
    are kept.  An empty table gives an empty result."""
    fps = materialise(fingerprints(docs, key, text, words), "simhash-fps")
    edges = materialise(link(fps, radius, tile), "simhash-edges")  # read twice
    roots = connected_components(edges).select(F.col("node").alias("fp"), "root")
    least = materialise(fps.groupBy("fp").agg(F.min(key).alias("least")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    component = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(component, "fp").select(key, "fp", "component_id")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(F.col(key).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
