"""Mixing sources to target weights, with DataFrame functions only.

The documents of a source are dealt into buckets by a hash, and in each bucket they stand in the order of key and text hash.  The words of a
bucket are packed into blocks of a fixed number of words; what is left at its end is a short block.  The full blocks of a
source are numbered through its buckets, and then its short ones.  Every output shard draws its source counts from a
multinomial over the targets; the draws of a source are numbered through the shards, and
where they miss the source's exact number of slots the surplus slots are handed to the
sources that lack some.  Slot ``i`` of a source reads block ``permutation(i)`` of epoch
``i div blocks``; the permutation (swap-or-not) is a bijection of the full blocks' numbers, short blocks follow in order, so
within an epoch no block comes twice.  Blocks are joined by ``(source, bucket, block)``.

The last slot of a source is cut to the word, so a source gives its target exactly,
rounded.  Texts are shuffled once, to their buckets, where the blocks are packed and met by the slots that read them.  Running sums go
by runs; nothing needs one source in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.llm.common import materialise, parts_for, running_sum

WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
SHARD_SLOTS = 4096
SEED = 17
ROUNDS = 24
#: Rows of a source in one bucket, on average; sources with a smaller share of all rows than one in so many are dealt into as many buckets as that share needs.
BUCKET_ROWS, LISTED = 2_000, 10_000
#: Cells of the table that finds a draw's source, for each source.
CELLS = 16
#: Rows and bytes of names up to which the table of sources goes to every task.
SMALL_ROWS, SMALL_BYTES = 20_000, 2 << 20


def _below(n: Column, *of: Column) -> Column:
    """A pseudorandom number from 0 to n - 1."""
    return F.pmod(F.xxhash64(*of), n)


def permuted(x: Column, n: Column, *of: Column) -> Column:
    """``x`` under a pseudorandom permutation of 0 .. n - 1 that ``of`` chooses: in each round x and its
    mirror image (K - x) mod n change places or not, as a bit of the larger of them says."""

    def step(y: Column, k: Column) -> Column:
        mirror = F.pmod(_below(n, k, *of) - y, n)
        return F.when(F.xxhash64(F.greatest(y, mirror), k, *of).bitwiseAND(1) == 1, mirror).otherwise(y)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)).otherwise(x.cast("long"))


#: A source, as two columns without nulls.
SOURCE = ["s_name", "s_null"]


def _exact(source: Column) -> list[Column]:
    return [F.coalesce(source.cast("string"), F.lit("")).alias("s_name"), F.isnull(source).alias("s_null")]


def _source() -> Column:
    return F.when(~F.col("s_null"), F.col("s_name")).alias("source")


def sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``(key, source, h, size)`` of every row: number of words and a hash of the text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), *_exact(F.col(source)), F.xxhash64(t).alias("h"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"))


def _dealt(df: DataFrame, base: DataFrame) -> DataFrame:
    """``df`` (with source, ``key`` and ``h``) and ``bucket``: a source has buckets by its rows in ``base``.  Sources with a ten-thousandth
    of all rows are listed for every task, so the list is bounded whatever the number of sources."""
    total = base.count()
    listed = base.groupBy(*SOURCE).count().where(F.col("count") > max(BUCKET_ROWS, total // LISTED))
    listed = F.broadcast(listed.select(*SOURCE, F.ceil(F.col("count") / BUCKET_ROWS).alias("buckets")))
    buckets = F.coalesce("buckets", F.lit(parts_for(total // LISTED, BUCKET_ROWS)))
    return df.join(listed, SOURCE, "left").withColumn("bucket", F.pmod(F.xxhash64("key", "h"), buckets)).select(*df.columns, "bucket")


def placed(base: DataFrame) -> DataFrame:
    """``base`` with its bucket and ``start``, the words before it in the bucket's part of its source.  The order is by key and text hash;
    rows that tie in these are alike."""
    w = Window.partitionBy(*SOURCE, "bucket").orderBy("key", "h", "size").rowsBetween(Window.unboundedPreceding, 0)
    return _dealt(base, base).withColumn("start", F.sum("size").over(w) - F.col("size"))


def bucket_blocks(base: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Of each bucket of each source its full blocks, the words of its short one, and what of these the source has in the buckets before."""
    b = base.groupBy(*SOURCE, "bucket").agg(F.sum("size").alias("n")).where("n > 0")
    b = b.select(*SOURCE, "bucket", F.floor(F.col("n") / block).alias("full"), (F.col("n") % block).alias("rest"))
    for out, value in (("first_full", F.col("full")), ("first_short", F.when(F.col("rest") > 0, 1).otherwise(0)), ("short_words", F.col("rest"))):
        b = running_sum(b, value, SOURCE, ["bucket"], out)
    return b


def source_plan(base: DataFrame, buckets: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK_WORDS) -> DataFrame:
    """A row for each source: size, weight, target, and how its slots are laid out.

    Targets are ``min(most * size, level * weight)`` with the one level at which they add up: sources are taken in
    the order in which a rising level caps them."""
    by_name = Window.orderBy("s_null", "s_name")
    everything = Window.partitionBy()
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    s = base.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    s = s.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("at", F.col("cap") / F.col("weight"))
    capped = Window.orderBy("at", "s_null", "s_name").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.least(share * F.sum("source_size").over(everything), F.sum("cap").over(everything)))
    s = s.withColumn("rest", F.col("all") - F.coalesce(F.sum("cap").over(capped), F.lit(0.0)))
    s = s.withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(capped), F.lit(0.0)))
    level = F.col("rest") / F.greatest(F.col("rest_weight"), F.lit(1e-9))
    # the level if no source from here on were capped; the right one is the first that is under its own cap
    s = s.withColumn("level", F.min(F.when(level <= F.col("at"), F.struct("at", level.alias("level")))).over(everything)["level"])
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    packed = buckets.groupBy(*SOURCE).agg(F.sum("full").alias("full"), F.count(F.when(F.col("rest") > 0, 1)).alias("shorts"))
    s = s.join(packed, SOURCE, "left").fillna(0, ["full", "shorts"])
    n, t = F.col("source_size"), F.round("target").cast("long")
    s = s.withColumn("blocks", F.col("full") + F.col("shorts")).withColumn("epochs", F.when(n > 0, F.floor(t / F.greatest(n, F.lit(1)))).otherwise(0).cast("long"))
    s = s.withColumn("part", t - F.col("epochs") * n).withColumn("part_full", F.least(F.ceil(F.col("part") / block), F.col("full")))
    s = s.withColumn("over", F.greatest(F.col("part") - F.col("full") * block, F.lit(0)))
    # short blocks that the last, partial epoch reads, and the words of those before the last of them
    p = _small(s.where("over > 0").select(*SOURCE, "over"), "s_name")
    short = buckets.where("rest > 0").join(p, SOURCE).where("short_words < over").groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("part_short"), F.max("short_words").alias("short_before"))
    s = s.join(short, SOURCE, "left").fillna(0, ["part_short", "short_before"])
    s = s.withColumn("part_slots", F.col("part_full") + F.col("part_short"))
    s = s.withColumn("last_words", F.when(F.col("over") > 0, F.col("over") - F.col("short_before")).otherwise(F.col("part") - F.greatest(F.col("part_full") - 1, F.lit(0)) * block))
    s = s.withColumn("slots", F.col("epochs") * F.col("blocks") + F.col("part_slots"))
    s = s.withColumn("lo", F.sum("slots").over(by_name) - F.col("slots"))
    return s.select(*SOURCE, _source(), "source_size", "target", "blocks", "full", "epochs", "part_slots", "last_words", "slots", "lo")


def _small(df: DataFrame, name: str = "s_name") -> DataFrame:
    """``df`` marked for broadcast if it was counted and found small; as it is otherwise."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL_ROWS and size <= SMALL_BYTES else df


def draw_slots(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``(source, shard, slot)``: every slot number of every source once, in the shard that drew it."""
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    n_sources = max(1, plan.count())
    width = max(1, total // (CELLS * n_sources))
    cells = plan.where("slots > 0").select(
        *SOURCE, "lo", (F.col("lo") + F.col("slots")).alias("hi"), F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("slots") - 1) / width))).alias("cell")
    )
    draws = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), _below(F.lit(max(1, total)), F.lit(seed), F.col("id")).alias("x"))
    draws = draws.withColumn("cell", F.floor(F.col("x") / width))
    counts = draws.join(_small(cells), "cell").where("x >= lo and x < hi").groupBy(*SOURCE, "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = running_sum(counts, F.col("n"), SOURCE, ["shard"], "first")
    counts = materialise(counts.join(_small(plan.select(*SOURCE, "slots")), SOURCE), "mix-draws")
    kept = counts.where("first < slots").select(*SOURCE, "shard", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + F.col("n"), F.col("slots")) - 1)).alias("slot"))
    # draws beyond a source's slots go, in order, to the slots that no draw reached
    surplus = counts.where("first + n > slots").select(*SOURCE, "shard", (F.col("first") + F.col("n") - F.greatest("first", "slots")).alias("k"))
    drawn = counts.groupBy(*SOURCE).agg(F.sum("n").alias("drawn"))
    lacking = plan.join(_small(drawn), SOURCE, "left").select(*SOURCE, F.coalesce("drawn", F.lit(0)).alias("drawn"), "slots").where("drawn < slots")
    surplus = running_sum(surplus, F.col("k"), [], ["shard", "s_null", "s_name"], "from").select("shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("k") - 1)).alias("unit"))
    by_name = Window.orderBy("s_null", "s_name")  # a row for each source
    lacking = lacking.withColumn("to", F.sum(F.col("slots") - F.col("drawn")).over(by_name)).withColumn("from", F.col("to") - F.col("slots") + F.col("drawn"))
    lacking = lacking.select(*SOURCE, "drawn", "from", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("unit"))
    moved = surplus.join(lacking, "unit").select(*SOURCE, "shard", (F.col("drawn") + F.col("unit") - F.col("from")).alias("slot"))
    return kept.unionByName(moved)


def block_slots(plan: DataFrame, buckets: DataFrame, slots: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``(source, shard, slot, epoch, bucket, block, words)``: what each slot reads; ``words`` from the block's start."""
    p = _small(plan.select(*SOURCE, "blocks", "full", "epochs", "part_slots", "last_words", F.col("slots").alias("n_slots")))
    j = slots.join(p, SOURCE)
    epoch = F.least(F.floor(F.col("slot") / F.greatest("blocks", F.lit(1))), F.col("epochs"))
    j = j.withColumn("epoch", epoch).withColumn("pos", F.col("slot") - F.col("epoch") * F.col("blocks"))
    full = F.col("pos") < F.col("full")
    number = F.when(full, permuted(F.col("pos"), F.col("full"), F.col("s_name"), F.col("s_null"), F.col("epoch"), F.lit(seed))).otherwise(F.col("pos") - F.col("full"))
    cut = F.when((F.col("slot") == F.col("n_slots") - 1) & (F.col("part_slots") > 0), F.col("last_words"))
    j = j.select(*SOURCE, "shard", "slot", "epoch", (~full).alias("short"), number.alias("number"), cut.alias("cut"))
    whole = buckets.where("full > 0").select(*SOURCE, F.lit(False).alias("short"), "first_full", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("block"), F.lit(block).cast("long").alias("n"))
    whole = whole.withColumn("number", F.col("first_full") + F.col("block")).drop("first_full")
    rest = buckets.where("rest > 0").select(*SOURCE, F.lit(True).alias("short"), F.col("first_short").alias("number"), "bucket", F.col("full").alias("block"), F.col("rest").alias("n"))
    # as many rows as blocks, which no estimate knows before the explosion: not to be broadcast
    j = j.join(whole.unionByName(rest).hint("merge"), [*SOURCE, "short", "number"])
    return j.select(*SOURCE, _source(), "shard", "slot", "epoch", "bucket", "block", F.coalesce("cut", "n").cast("long").alias("words"))


def taken_ranges(base: DataFrame, reads: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``(key, source, h, size, bucket, start, from, to, copy)``: the words that the mix takes of each document, by copy."""
    epoch_reads = reads.groupBy(*SOURCE, "bucket", "block").agg(F.sort_array(F.collect_list("words"), asc=False).alias("reads"))
    pieces = base.where("size > 0").hint("merge").select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    j = pieces.join(epoch_reads, [*SOURCE, "bucket", "block"])
    j = j.select(*DOCUMENT, "block", F.posexplode("reads").alias("copy", "words"))
    at = F.col("block") * block
    lo, hi = F.greatest(F.col("start"), at), F.least(F.col("start") + F.col("size"), at + F.col("words"))
    return j.where(lo < hi).select(*DOCUMENT, (lo - F.col("start")).alias("from"), (hi - F.col("start")).alias("to"), "copy")


#: Columns of a placed document.
DOCUMENT = ["key", *SOURCE, "h", "size", "bucket", "start"]


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK_WORDS, shard_slots=SHARD_SLOTS, seed=SEED):
    """``(base, plan, reads)``: the placed documents, the plan of the sources, and the block reads of the mix.

    A null source is a source, last in order; a null text has size 0; sources of size 0 have target 0; repeated rows
    are documents of their own; an empty table gives empty tables.  Columns other than the three aren't looked at."""
    base = materialise(placed(materialise(sized(docs, key, source, text), "mix-sizes")), "mix-placed")
    buckets = materialise(bucket_blocks(base, block), "mix-buckets")
    plan = materialise(source_plan(base, buckets, weights, share, most, block), "mix-plan")
    return base, plan, materialise(block_slots(plan, buckets, draw_slots(plan, shard_slots, seed), block, seed), "mix-reads")


def taken(base: DataFrame, plan: DataFrame, reads: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``(key, source, size, source_size, target, taken)`` of every document, as the plan of the reads has it."""
    r = taken_ranges(base, reads, block).select(*SOURCE, "bucket", "start", (F.col("to") - F.col("from")).alias("n"))
    return _by_document(base, plan, r)


def counted(base: DataFrame, plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """``(key, source, size, source_size, target, taken)`` of every document, counted from the words in the blocks of the mix."""
    n = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.size(F.slice("words", x["at"] + 1, x["n"])).cast("long").alias("n")))
    return _by_document(base, plan, mixed.select(*SOURCE, "bucket", F.explode(n).alias("x")).select(*SOURCE, "bucket", "x.start", "x.n"))


def _by_document(base: DataFrame, plan: DataFrame, words: DataFrame) -> DataFrame:
    """The words ``(source, bucket, start, n)`` summed for each document; where a document of words starts tells it from all others of its bucket."""
    all_ = base.where("size > 0").select(*SOURCE, "bucket", "start", "key", "size", F.lit(0).cast("long").alias("n"))
    all_ = all_.unionByName(words.select(*SOURCE, "bucket", "start", "n"), allowMissingColumns=True)
    got = all_.groupBy(*SOURCE, "bucket", "start").agg(F.max("key").alias("key"), F.max("size").alias("size"), F.sum("n").alias("taken")).drop("bucket", "start")
    got = got.unionByName(base.where("size = 0").select(*SOURCE, "key", "size", F.lit(0).cast("long").alias("taken")))
    return got.join(_small(plan.select(*SOURCE, "source_size", "target")), SOURCE).select("key", _source(), "size", "source_size", "target", "taken")


def _packed(docs: DataFrame, base: DataFrame, reads: DataFrame | None, key: str, source: str, text: str, block: int) -> DataFrame:
    """``(source, bucket, block, words, spans, reads)``: texts and the slots that read their blocks go to the buckets in one shuffle;
    blocks are packed there."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.where(t.rlike(WORD)).select(F.col(key).alias("key"), *_exact(F.col(source)), F.xxhash64(t).alias("h"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"))
    d = _dealt(d.select(*SOURCE, F.lit(0).alias("kind"), "key", "h", F.size("w").cast("long").alias("size"), F.array_join("w", " ").alias("t")), base)
    read = "struct<shard:bigint,slot:bigint,words:bigint>"
    d = d.withColumn("block", F.lit(None).cast("long")).withColumn("read", F.lit(None).cast(read))
    if reads is not None:
        r = reads.select(*SOURCE, "bucket", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("size"), "block", F.struct("shard", "slot", "words").cast(read).alias("read"))
        d = d.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*SOURCE, "bucket").orderBy("kind", "key", "h", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("start", F.sum("size").over(w) - F.col("size")).withColumn("w", F.split("t", " "))

    def part(k: Column) -> Column:
        lo, hi = F.greatest(F.col("start"), k * block), F.least(F.col("start") + F.col("size"), (k + 1) * block)
        n = (hi - lo).cast("int")
        words = F.array_join(F.slice("w", (lo - F.col("start") + 1).cast("int"), n), " ")
        return F.struct(k.alias("block"), F.struct((lo - k * block).cast("int").alias("at"), F.col("start"), n.alias("n"), words.alias("w")).alias("part"), F.lit(None).cast(read).alias("read"))

    parts = F.transform(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)), part)
    none = F.lit(None).cast("struct<at:int,start:bigint,n:int,w:string>")
    rows = F.when(F.col("kind") == 0, parts).otherwise(F.array(F.struct("block", none.alias("part"), "read")))
    d = d.select(*SOURCE, "bucket", F.explode(rows).alias("x")).select(*SOURCE, "bucket", "x.block", "x.part", "x.read")
    d = d.groupBy(*SOURCE, "bucket", "block").agg(F.sort_array(F.collect_list("part")).alias("p"), F.collect_list("read").alias("reads"))
    if reads is not None:
        d = d.where(F.size("reads") > 0)
    words = F.flatten(F.transform("p", lambda x: F.split(x["w"], " ")))
    spans = F.transform("p", lambda x: F.struct(x["at"].alias("at"), x["start"].alias("start"), x["n"].alias("n")))
    return d.select(*SOURCE, _source(), "bucket", "block", words.alias("words"), spans.alias("spans"), "reads")


def packed_blocks(docs: DataFrame, base: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """``(source, bucket, block, words array<string>, spans)``: the blocks themselves, and whose their words are: of each document
    its place in the block, its ``start`` in the bucket and its number of words.

    Null and empty texts have no words and so no place; repeated rows are packed as often as they come; an empty table gives no rows."""
    return _packed(docs, base, None, key, source, text, block).drop("reads")


def mixed_blocks(docs: DataFrame, base: DataFrame, reads: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """``(shard, source, slot, bucket, words array<string>, spans)``: the mix, block by block.  Spans are those of the whole block, of
    which a cut slot has the first words.  Rows as in ``packed_blocks``."""
    b = _packed(docs, base, reads, key, source, text, block)
    j = b.select(*SOURCE, "source", "bucket", F.explode("reads").alias("r"), "words", "spans")
    return j.select("r.shard", *SOURCE, "source", "r.slot", "bucket", F.slice("words", F.lit(1), F.col("r.words").cast("int")).alias("words"), "spans")


def _keys(key: Column, source: Column) -> list[Column]:
    """Key and source as strings that no other value or null shares."""
    told = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c.cast("string")))
    return [told(key).alias("k_id"), told(source).alias("k_source")]


def _numbered(base: DataFrame) -> DataFrame:
    b = base.select("*", *_keys(F.col("key"), _source()))
    return b.withColumn("rn", F.row_number().over(Window.partitionBy("k_id", "k_source", "h").orderBy("start")))


def mixed_documents(docs: DataFrame, base: DataFrame, reads: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: a row for each copy of a document that the mix takes, with the columns of ``docs``.

    A copy taken whole keeps its text; one taken in part has the words taken, each with the white space before it.  Null and empty texts have
    nothing to take and no row; of rows with one key, source and text each has its own copies; an empty table gives no rows."""
    r = taken_ranges(base, reads, block)
    copies = r.groupBy(*DOCUMENT, "copy").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("ranges"))
    copies = copies.groupBy(*DOCUMENT).agg(F.collect_list("ranges").alias("copies"))
    copies = _numbered(copies).select("k_id", "k_source", "h", "rn", "size", "copies")
    d = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"), *_keys(F.col(key), F.col(source)))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("k_id", "k_source", "h").orderBy(F.lit(0))))
    j = d.join(copies, ["k_id", "k_source", "h", "rn"]).select("row", "size", F.explode("copies").alias("ranges"))
    t = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    words = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    pieces = F.regexp_extract_all(t, F.lit(PIECE), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("ranges", lambda x: F.slice(pieces, (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")))), "")
    new = F.when(words == F.col("size"), t).otherwise(cut)
    return j.select(new.alias("__text"), "row").select(*[(F.col("__text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
