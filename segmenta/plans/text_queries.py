"""Queries over texts: cleaning, sentences, lines, words, tokens, windows, overlaps, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmenta.config import WindowConfig
from segmenta.functions import text as T
from segmenta.operators import spans as S
from segmenta.operators import tokens as K
from segmenta.plans.common import table

WINDOW = WindowConfig(64, 16, 64)
LIMIT = 20
SPECIAL = ["the", ".", ","]
EVERY = 37  # a span for every so many characters


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def clean_ascii(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean_ascii(F.col("text"))).alias("h"), F.length(T.clean_ascii(F.col("text"))).cast("long").alias("n"))


def clean_line(spark, sf_dir):
    c = T.clean_line(F.concat(F.lit(" \t"), F.col("text"), F.lit(" \r\n\n")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", c.alias("line"))


def sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent", "sentence")).select("doc_id", F.col("sent").cast("long").alias("sent"), "sentence")


def sentence_limit(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent", "s"))
    d = d.select("doc_id", "sent", F.posexplode(T.split_long(F.col("s"), LIMIT)).alias("part", "text"))
    return d.select("doc_id", F.col("sent").cast("long").alias("sent"), F.col("part").cast("long").alias("part"), T.count_tokens(F.col("text")).cast("long").alias("n"), F.regexp_replace("text", r"(?U)\s", "").alias("text"))


def lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def word_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.count_tokens(F.col("text")).cast("long").alias("n_tokens"), T.prefix(F.col("text")).alias("head"))


def token_offsets(spark, sf_dir):
    t = K.token_rows(_docs(spark, sf_dir))
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("pos").cast("long") * F.col("c_start")).alias("starts"),
        F.sum(F.col("pos").cast("long") * F.col("c_end")).alias("ends"),
        F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "token")))["token"], " ")).alias("h"),
    )


def special_filter(spark, sf_dir):
    t = K.without_special(K.token_rows(_docs(spark, sf_dir)), SPECIAL)
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").cast("long").alias("last"), F.sum(F.col("pos").cast("long") * F.col("c_start")).alias("starts"))


def token_windows(spark, sf_dir):
    w = K.window_rows(_docs(spark, sf_dir), WINDOW)
    return w.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("win_id", "start", "end", "own_from", "own_to")], F.md5(F.array_join("tokens", " ")).alias("h"))


def _neighbours(spark, sf_dir):
    w = K.window_rows(_docs(spark, sf_dir), WINDOW)
    return w.withColumn("before", F.lag("tokens").over(Window.partitionBy("doc_id").orderBy("win_id"))).where("before is not null")


def overlap_exact(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", F.col("win_id").cast("long").alias("win_id"), K.exact_overlap(F.col("before"), F.col("tokens")).cast("long").alias("overlap"))


def overlap_fuzzy(spark, sf_dir):
    return K.fuzzy_overlap(_neighbours(spark, sf_dir), "before", "tokens").select("doc_id", F.col("win_id").cast("long").alias("win_id"), F.col("overlap").cast("long").alias("overlap"))


def stitch_windows(spark, sf_dir):
    """Every token once, from the window that owns it; the stitched text is the document's."""
    t = K.owned(K.token_rows(_docs(spark, sf_dir)), WINDOW).where("owned")
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("n_distinct"), F.sum(F.col("win_id").cast("long") * F.col("pos")).alias("owners"),
        F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "token")))["token"], " ")).alias("h"),
    )


def char_spans(spark, sf_dir):
    """The turns of a conversation as chunks of its joined text."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    c = c.select("conv_id", "t.turn", S.char_spans(F.array_join("t.text", "\n"), F.col("t.text")).alias("s"))
    c = c.select("conv_id", F.explode(F.arrays_zip("turn", "s")).alias("z"))
    return c.select("conv_id", F.col("z.turn").alias("turn"), F.col("z.s.c_start").cast("long").alias("c_start"), F.col("z.s.c_end").cast("long").alias("c_end"))


def token_spans(spark, sf_dir):
    """Spans of 20 characters, one for every 37; many begin in a gap or end beyond the text."""
    d = _docs(spark, sf_dir)
    s = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / EVERY))).alias("span_id"))
    s = s.select("doc_id", "span_id", (F.col("span_id") * EVERY).alias("c_start"), (F.col("span_id") * EVERY + 20).alias("c_end"))
    out = S.token_spans(K.token_rows(d), s)
    return out.select("doc_id", "span_id", F.col("t_start").cast("long").alias("t_start"), F.col("t_end").cast("long").alias("t_end"))


_TOK = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"
_PIECES = r"\s+|[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(13))"
SENTENCE_SQL = rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent, sentence FROM (
  SELECT doc_id, generate_subscripts(l, 1) AS i, {_TRIM.format('unnest(l)')} AS sentence FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace({_TRIM.format('text')}, '([.?!|])(\s)', '\1' || chr(1) || '\2', 'g'), '\n{{1,2}}(\S)', chr(1) || '\1', 'g'), chr(1)) AS l FROM documents))
WHERE sentence <> ''"""
TOKENS_SQL = rf"""SELECT doc_id, pos, token, c_start, c_end FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (
    SELECT doc_id, i, token, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS c_end, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i) - length(token) AS c_start FROM (
      SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{_PIECES}') AS l FROM documents)))
  WHERE NOT regexp_matches(token, '^\s'))"""
WINDOWS_SQL = f"""WITH n AS (SELECT doc_id, count(*) AS n FROM ({TOKENS_SQL}) GROUP BY doc_id),
  w AS (SELECT doc_id, n, unnest(CASE WHEN n <= {{size}} THEN [0] ELSE range(0, (n + {{step}} - 1) // {{step}}) END) AS win_id FROM n WHERE n > 0),
  s AS (SELECT doc_id, n, win_id, win_id * {{step}} AS w_start, least(win_id * {{step}} + {{size}}, n) AS w_end FROM w),
  b AS (SELECT *, CASE WHEN win_id = 0 THEN 0 ELSE (w_start + lag(w_end) OVER o + 1) // 2 END AS own_from FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY win_id)),
  win AS (SELECT *, coalesce(lead(own_from) OVER (PARTITION BY doc_id ORDER BY win_id), n) AS own_to FROM b)"""


def windows_sql(size: int, overlap: int) -> str:
    return WINDOWS_SQL.replace("{size}", str(size)).replace("{step}", str(size - overlap))


_W = windows_sql(64, 16)

QUERIES = {f.__name__: f for f in (clean_ascii, clean_line, sentences, sentence_limit, lines, word_tokens, token_counts, token_offsets, special_filter, token_windows, overlap_exact, overlap_fuzzy, stitch_windows, char_spans, token_spans)}

ORACLES = {
    "clean_ascii": r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\x20-\x7E\n]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents)
      SELECT doc_id, md5(t) AS h, length(t) AS n FROM c""",
    "clean_line": rf"""SELECT conv_id, turn, regexp_replace(replace(regexp_replace(replace(replace({_TRIM.format("chr(32) || chr(9) || text || ' ' || chr(13) || chr(10) || chr(10)")}, chr(13), ''), chr(9), ' '), '\n+', chr(10), 'g'), chr(10), '| '), ' +', ' ', 'g') AS line
      FROM conversations""",
    "sentences": SENTENCE_SQL,
    "sentence_limit": rf"""WITH s AS (SELECT doc_id, sent, regexp_extract_all(sentence, '{_TOK}') AS t FROM ({SENTENCE_SQL}))
      SELECT doc_id, sent, p // {LIMIT} AS part, least({LIMIT}, len(t) - p) AS n, array_to_string(t[p + 1 : p + {LIMIT}], '') AS text
      FROM (SELECT doc_id, sent, t, unnest(range(0, len(t), {LIMIT})) AS p FROM s)""",
    "lines": rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, line FROM (
      SELECT doc_id, generate_subscripts(l, 1) AS i, {_TRIM.format('unnest(l)')} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''""",
    "word_tokens": r"""SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_À-ž\s-]', '', 'g'), '\s+')) AS word FROM documents)
      WHERE word <> '' GROUP BY ALL""",
    "token_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{_TOK}')) AS n_tokens, text[:100] AS head FROM documents",
    "token_offsets": f"""SELECT doc_id, count(*) AS n, sum(pos * c_start)::BIGINT AS starts, sum(pos * c_end)::BIGINT AS ends, md5(string_agg(token, ' ' ORDER BY pos)) AS h
      FROM ({TOKENS_SQL}) GROUP BY doc_id""",
    "special_filter": f"""SELECT doc_id, count(*) AS n, max(p) AS last, sum(p * c_start)::BIGINT AS starts FROM (
      SELECT doc_id, c_start, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM ({TOKENS_SQL}) WHERE token NOT IN ('the', '.', ',')) GROUP BY doc_id""",
    "token_windows": f"""{_W} SELECT win.doc_id, win_id, w_start AS start, w_end AS "end", own_from, own_to, md5(array_to_string(t.l[w_start + 1 : w_end], ' ')) AS h
      FROM win JOIN (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS l FROM documents) t ON t.doc_id = win.doc_id""",
    "overlap_exact": f"""{_W}, x AS (SELECT win.doc_id, win_id, t.l[w_start + 1 : w_end] AS cur, lag(t.l[w_start + 1 : w_end]) OVER (PARTITION BY win.doc_id ORDER BY win_id) AS prev
      FROM win JOIN (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS l FROM documents) t ON t.doc_id = win.doc_id)
      SELECT doc_id, win_id, list_max(list_filter(range(0, least(len(prev), len(cur)) + 1), lambda n: n = 0 OR prev[len(prev) - n + 1 :] = cur[: n])) AS overlap FROM x WHERE prev IS NOT NULL""",
    "stitch_windows": f"""{_W} SELECT t.doc_id, count(*) AS n, count(DISTINCT pos) AS n_distinct, sum(win_id * pos)::BIGINT AS owners, md5(string_agg(token, ' ' ORDER BY pos)) AS h
      FROM ({TOKENS_SQL}) t JOIN win ON win.doc_id = t.doc_id AND pos >= own_from AND pos < own_to GROUP BY t.doc_id""",
    "char_spans": """SELECT conv_id, turn, (c_end - length(text))::BIGINT AS c_start, c_end::BIGINT AS c_end FROM (
      SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS c_end FROM conversations)""",
    "token_spans": f"""WITH s AS (SELECT doc_id, span_id, span_id * {EVERY} AS a, span_id * {EVERY} + 20 AS b FROM (SELECT doc_id, unnest(range(0, length(text) // {EVERY} + 1)) AS span_id FROM documents)),
      t AS MATERIALIZED ({TOKENS_SQL}), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
      u AS (SELECT doc_id, pos, unnest(range(c_start::BIGINT, c_end::BIGINT)) AS at FROM t)
      SELECT s.doc_id, s.span_id, coalesce(CASE WHEN x.pos <= coalesce(y.pos, n.n) THEN x.pos END, 0) AS t_start, coalesce(y.pos + 1, n.n) AS t_end
      FROM s JOIN n ON n.doc_id = s.doc_id LEFT JOIN u x ON x.doc_id = s.doc_id AND x.at = s.a LEFT JOIN u y ON y.doc_id = s.doc_id AND y.at = s.b - 1""",
}
