"""Queries of typed elements, split scores, split points, and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.config import SplitConfig
from segmenta.operators import scoring, splits, structure
from segmenta.plans.common import r6, table
from segmenta.plans.text_queries import _TOK, _TRIM
from segmenta.sources import io

CONFIG = SplitConfig()
#: Lines that the documents hardly have: every kind of list mark, and headings on both sides of the threshold.
FIXTURE = [
    "1) one", "2) two", "plain text that goes on and ends in a stop.", "1. one", "2. two", "1a first", "1b second", "3 apples", "- dash", "* star", "a. letter", "b) letter",
    "iv", "V", "1st place", "2nd place", "[12] bracket", "Chapter One", "This line is longer than the heading above it and ends here.", "ALL CAPS HEADING", "short", "Mixed case Heading",
    "A very long line without an end that has more than fifty characters in all", "x.", "1", "2", "10", "11) eleven", "12 twelve",
]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture = spark.createDataFrame([(-1, "\n".join(FIXTURE))], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fixture)


def _elements(spark, sf_dir):
    e = structure.elements(_docs(spark, sf_dir))
    return e.select("doc_id", "pos", "type", "text", F.col("metadata.token_size").alias("token_size"), F.col("metadata.page_number").alias("page_number"))


def _scored(spark, sf_dir):
    return scoring.split_scores(_elements(spark, sf_dir))


def list_items(spark, sf_dir):
    d = structure.classified(structure.line_rows(_docs(spark, sf_dir)))
    return d.where("type = 'ListItem'").select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


def headings(spark, sf_dir):
    d = structure.classified(structure.line_rows(_docs(spark, sf_dir)))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "type", F.when(F.col("type") != "ListItem", F.col("points")).cast("long").alias("points"))


def elements(spark, sf_dir):
    e = structure.elements(_docs(spark, sf_dir))
    m = F.col("metadata")
    return e.select("doc_id", F.col("pos").cast("long").alias("pos"), "type", "element_id", "text", m["filename"].alias("filename"), m["token_size"].cast("long").alias("token_size"))


def _condition(name):
    def query(spark, sf_dir):
        e = _elements(spark, sf_dir)
        if name == "title":
            e = e.withColumn("v", scoring.title_condition(F.col("type")))
        elif name == "token":
            e = scoring.token_condition(e).withColumnRenamed("token_condition", "v")
        else:
            e = e.withColumn("v", scoring.first_list_item(F.col("type")))
        return e.select("doc_id", F.col("pos").cast("long").alias("pos"), r6(F.col("v")).alias("value"))

    return query


def _score_columns(df, extra=()):
    s = F.col("score")
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), *extra, *[r6(s[c]).alias(c) for c in ("title_condition", "token_condition", "first_listitem_condition", "sum")])


def score_titles_run(spark, sf_dir):
    """Titles alone, with what their runs make of their conditions."""
    return _score_columns(_scored(spark, sf_dir).where("type = 'Title' and pos > 0")).drop("sum")


def split_scores(spark, sf_dir):
    return _score_columns(_scored(spark, sf_dir), ("type",))


def _phrases(spark, sf_dir) -> list[str]:
    """The list of phrases is a parameter: the whole texts of all benchmark items."""
    return [r["text"] for r in table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").collect()]


def phrase_search(spark, sf_dir):
    h = scoring.phrase_hits(_elements(spark, sf_dir), _phrases(spark, sf_dir))
    return h.select("doc_id", "phrase", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), r6(F.col("score")).alias("score"))


def phrase_scores(spark, sf_dir):
    d = scoring.split_scores(_elements(spark, sf_dir), _phrases(spark, sf_dir))
    return _score_columns(d, (F.col("score.phrases_condition").alias("phrases_condition"),))


def top_elements(spark, sf_dir):
    return _score_columns(splits.top_elements(_scored(spark, sf_dir)), (F.col("rank").cast("long").alias("rank"),)).select("doc_id", "pos", "rank", "sum")


def initial_splits(spark, sf_dir):
    return splits.initial_splits(_scored(spark, sf_dir)).select("doc_id", F.col("split_idx").cast("long").alias("split_idx"), r6(F.col("score")).alias("score"))


def _ranges(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s, splits.chunk_ranges(s, splits.initial_splits(s))


def chunk_scores(spark, sf_dir):
    return _ranges(spark, sf_dir)[1].select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("split_idx", "end", "n_tokens")], r6(F.col("chunk_score")).alias("chunk_score"))


def avg_chunk_score(spark, sf_dir):
    return splits.average_chunk_score(_ranges(spark, sf_dir)[1]).select("doc_id", r6(F.col("avg_chunk_score")).alias("avg_chunk_score"))


def split_details(spark, sf_dir):
    s, r = _ranges(spark, sf_dir)
    d = splits.split_details(s, r)
    return d.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("split_idx", "end", "n_tokens")], r6(F.col("score")).alias("score"), r6(F.col("chunk_score")).alias("chunk_score"), "type", "snippet")


def zero_repair(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return splits.repaired_splits(s, splits.initial_splits(s)).select("doc_id", F.col("split_idx").cast("long").alias("split_idx"))


def refine(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return splits.refined_splits(s, splits.initial_splits(s)).select("doc_id", F.col("split_idx").cast("long").alias("split_idx"))


def split_points(spark, sf_dir):
    return splits.split_points(_scored(spark, sf_dir)).select("doc_id", F.col("split_idx").cast("long").alias("split_idx"))


def element_roundtrip(spark, sf_dir):
    """Elements as lines of literals and back."""
    e = structure.elements(_docs(spark, sf_dir)).drop("doc_id", "pos")
    p = io.parse_elements(io._literal(e))
    return p.select("element_id", "type", "text", F.col("metadata.element_number").cast("long").alias("pos"), F.col("metadata.token_size").cast("long").alias("token_size"))


_LINES = rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, text FROM (
  SELECT doc_id, generate_subscripts(l, 1) AS i, {_TRIM.format('unnest(l)')} AS text FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[^\x20-\x7E\n]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS l
    FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, array_to_string([{", ".join("'" + x.replace("'", "''") + "'" for x in FIXTURE)}], chr(10))))) WHERE text <> ''"""
_TYPED = rf"""raw AS MATERIALIZED ({_LINES}),
  cand AS (SELECT *, regexp_matches(text, '^[-*+]') OR regexp_matches(text, '^\d+[.)]') OR regexp_matches(text, '^[a-zA-Z][.)]') OR regexp_matches(text, '^[(\[{{]?\d+[)\]}}]?')
      OR regexp_matches(text, '^(?i:i|ii|iii|iv|v|vi|vii|viii|ix|x)$') AS c,
    TRY_CAST(nullif(regexp_extract(text, '^(\d+)([.a-z]*)', 1), '') AS HUGEINT) AS n, regexp_extract(text, '^(\d+)([.a-z]*)', 2) AS s FROM raw),
  near AS (SELECT *, lag(c) OVER w AS pc, lag(n) OVER w AS pn, lag(s) OVER w AS ps, lead(c) OVER w AS nc, lead(n) OVER w AS nn, lead(s) OVER w AS ns, lead(length(text)) OVER w AS nl FROM cand WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  item AS (SELECT *, c AND (
      coalesce(pc AND (n IS NULL OR coalesce(n = pn + 1 AND s = '' OR (length(ps) = 1 AND length(s) = 1 AND ps <> '.' AND s <> '.' AND pn IS NOT NULL AND ascii(s) - ascii(ps) = 1), false)), false)
      OR coalesce(nc AND (n IS NULL OR coalesce(nn = n + 1 AND ns = '' OR (length(s) = 1 AND length(ns) = 1 AND s <> '.' AND ns <> '.' AND nn IS NOT NULL AND ascii(ns) - ascii(s) = 1), false)), false)) AS li FROM near),
  pts AS (SELECT *, (CASE WHEN length(text) BETWEEN 5 AND 50 THEN 3 ELSE 0 END)
      + (CASE WHEN (regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[A-Za-z][A-Z]') AND NOT regexp_matches(text, '(^|[^A-Za-z])[a-z]')) OR (regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]')) THEN 2 ELSE 0 END)
      + (CASE WHEN coalesce(lag(li) OVER w, true) AND coalesce(lead(li) OVER w, true) THEN 1 ELSE 0 END)
      + (CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 1 ELSE 0 END) + (CASE WHEN coalesce(nl > length(text), false) THEN 3 ELSE 0 END) AS points FROM item WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  el AS MATERIALIZED (SELECT doc_id, pos, text, CASE WHEN li THEN 'ListItem' WHEN points >= 6 THEN 'Title' ELSE 'NarrativeText' END AS type, points, doc_id || '.txt' AS filename, len(regexp_extract_all(text, '{_TOK}')) AS token_size FROM pts)"""
_R = "round({}, 6) + 0.0"
_SCORED = f"""{_TYPED},
  c0 AS (SELECT *, CASE type WHEN 'Title' THEN 5.0::DOUBLE WHEN 'NarrativeText' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS t, count(*) FILTER (WHERE type = 'Title') OVER w AS section,
    CASE WHEN type = 'ListItem' AND coalesce(lag(type) OVER w, '') <> 'ListItem' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS l, CASE WHEN type = 'Title' AND coalesce(lag(type) OVER w, '') = 'Title' THEN 0 ELSE 1 END AS new FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  c1 AS (SELECT *, CASE WHEN type = 'Title' AND sum(token_size) OVER (PARTITION BY doc_id, section) > 100 THEN 5 + 0.01::DOUBLE * (sum(token_size) OVER (PARTITION BY doc_id, section) - 100) ELSE 0.0::DOUBLE END AS k,
    sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c0),
  c2 AS (SELECT *, count(*) OVER i AS size, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS place, max(t) OVER i AS mt, max(k) OVER i AS mk, max(l) OVER i AS ml FROM c1 WINDOW i AS (PARTITION BY doc_id, island)),
  c3 AS (SELECT doc_id, pos, text, type, token_size, CASE WHEN type <> 'Title' OR size = 1 THEN t WHEN place = 1 THEN mt ELSE 1 END AS t,
    CASE WHEN type <> 'Title' OR size = 1 THEN k WHEN place = 1 THEN mk ELSE 1 END AS k, CASE WHEN type <> 'Title' OR size = 1 THEN l WHEN place = 1 THEN ml ELSE 1 END AS l FROM c2),
  scored AS MATERIALIZED (SELECT *, CASE WHEN pos = 0 THEN coalesce(max(t + k + l) FILTER (WHERE pos > 0) OVER (PARTITION BY doc_id) + 1, t + k + l) ELSE t + k + l END AS score FROM c3)"""
_INITIAL = f"""{_SCORED},
  ini AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank, greatest(1, greatest(1, sum(token_size) OVER (PARTITION BY doc_id) // 400) * 2) AS k_,
      sum(token_size) OVER (PARTITION BY doc_id ORDER BY pos) - token_size AS before, sum(token_size) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM scored) WHERE rank <= k_),
  ran AS (SELECT *, coalesce(lead(pos) OVER w, n) AS e, coalesce(lead(before) OVER w, total) - before AS nt FROM ini WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  rng AS (SELECT *, CASE WHEN nt < 30 OR nt > 800 THEN 0.0::DOUBLE WHEN nt < 400 THEN score * (0.3::DOUBLE + 0.7::DOUBLE * (1 - (400 - nt) / 370::DOUBLE)) ELSE score * (0.3::DOUBLE + 0.7::DOUBLE * (1 - (nt - 400) / 400::DOUBLE)) END AS cs FROM ran)"""
_CONDS = f"{_R.format('t')} AS title_condition, {_R.format('k')} AS token_condition, {_R.format('l')} AS first_listitem_condition"

QUERIES = {
    **{f.__name__: f for f in (list_items, headings, elements)},
    **{f"score_{n}": _condition(n) for n in ("title", "token", "listitem")},
    **{f.__name__: f for f in (score_titles_run, split_scores, phrase_search, phrase_scores, top_elements, initial_splits, chunk_scores, avg_chunk_score, split_details, zero_repair, refine, split_points, element_roundtrip)},
}

ORACLES = {
    "list_items": f"WITH {_TYPED} SELECT doc_id, pos, text FROM el WHERE type = 'ListItem'",
    "headings": f"WITH {_TYPED} SELECT doc_id, pos, type, CASE WHEN type <> 'ListItem' THEN points END AS points FROM el",
    "elements": f"WITH {_TYPED} SELECT doc_id, pos, type, md5(filename || ':' || pos) AS element_id, text, filename, token_size FROM el",
    "score_title": f"WITH {_SCORED} SELECT doc_id, pos, {_R.format('t')} AS value FROM c1",
    "score_token": f"WITH {_SCORED} SELECT doc_id, pos, {_R.format('k')} AS value FROM c1",
    "score_listitem": f"WITH {_SCORED} SELECT doc_id, pos, {_R.format('l')} AS value FROM c1",
    "score_titles_run": f"WITH {_SCORED} SELECT doc_id, pos, {_CONDS} FROM scored WHERE type = 'Title' AND pos > 0",
    "split_scores": f"WITH {_SCORED} SELECT doc_id, pos, type, {_CONDS}, {_R.format('score')} AS sum FROM scored",
    "top_elements": f"WITH {_SCORED} SELECT doc_id, pos, rank, {_R.format('score')} AS sum FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM scored) WHERE rank <= 5",
    "initial_splits": f"WITH {_INITIAL} SELECT doc_id, pos AS split_idx, {_R.format('score')} AS score FROM ini",
    "chunk_scores": f'WITH {_INITIAL} SELECT doc_id, pos AS split_idx, e AS "end", nt::BIGINT AS n_tokens, {_R.format("cs")} AS chunk_score FROM rng',
    "avg_chunk_score": f"WITH {_INITIAL} SELECT doc_id, {_R.format('coalesce(avg(cs) FILTER (WHERE cs > 0), 0)')} AS avg_chunk_score FROM rng GROUP BY doc_id",
    "split_details": f'WITH {_INITIAL} SELECT doc_id, pos AS split_idx, e AS "end", nt::BIGINT AS n_tokens, {_R.format("score")} AS score, {_R.format("cs")} AS chunk_score, type, text[:100] AS snippet FROM rng',
    "element_roundtrip": f"WITH {_TYPED} SELECT md5(filename || ':' || pos) AS element_id, type, text, pos, token_size FROM el",
}
