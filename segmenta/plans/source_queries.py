"""Queries of files, element formats, collections, and plug-ins for tokenizers and embedders."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmenta.config import SemanticConfig
from segmenta.operators import embed as E
from segmenta.operators import pooling, scoring, semantic, structure
from segmenta.plans.common import r6, table
from segmenta.plans.structure_queries import _SCORED, _TYPED, _docs, _elements
from segmenta.plans.text_queries import SENTENCE_SQL
from segmenta.sources import io

DIM = 4
LIMIT = SemanticConfig(sentence_max=12, sentence_min=4)


def text_files(spark, sf_dir):
    """Every benchmark item as a text file, read back with what the file system says of it."""
    path = io.scratch(spark, "text-files")
    table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text").repartition("item").write.partitionBy("item").text(path)
    t = io.read_texts(spark, f"{path}/*/*.txt")
    item = F.regexp_extract("file_directory", r"item=(\d+)$", 1).cast("long")
    dated = F.col("last_modified").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$")
    return t.select(item.alias("item_id"), F.md5("text").alias("h"), dated.alias("dated"), F.col("filename").rlike(r"^part-.*\.txt$").alias("named"), F.col("doc_id").isNotNull().alias("has_id"))


def element_metadata(spark, sf_dir):
    """Elements of texts that come with the names and dates of their files, in columns."""
    d = _docs(spark, sf_dir).withColumn("file_directory", F.when(F.col("doc_id") % 2 == 0, "").otherwise("in")).withColumn("filename", F.concat("doc_id", F.lit(".txt"))).withColumn("last_modified", F.lit("2024-01-02T03:04:05"))
    e = io.elements_of(io.texts_from(d))
    m = F.col("metadata")
    return e.select("doc_id", F.col("pos").cast("long").alias("pos"), "element_id", *[m[c].alias(c) for c in ("detection_class_prob", "last_modified", "filetype", "parent_id", "file_directory", "filename")], *[m[c].cast("long").alias(c) for c in ("page_number", "element_number", "token_size")], F.array_join(m["languages"], ",").alias("languages"), F.size(m["coordinates"]["points"]).cast("long").alias("n_points"))


def _written(spark, elements, save_format):
    path = io.scratch(spark, f"elements-{save_format}")
    io.write_elements(elements, path, save_format)
    return io.read_elements(spark, path) if save_format == "txt" else spark.read.schema(io.ELEMENT).json(path)


def _saved(save_format):
    def query(spark, sf_dir):
        e = _written(spark, structure.elements(_docs(spark, sf_dir)).drop("doc_id", "pos"), save_format)
        m = F.col("metadata")
        return e.select("element_id", "type", "text", m["filename"].alias("filename"), m["element_number"].cast("long").alias("pos"), m["token_size"].cast("long").alias("token_size"))

    return query


def saved_scores(spark, sf_dir):
    """Scored elements, saved as lines of literals and read back."""
    full = structure.elements(_docs(spark, sf_dir)).select("doc_id", "pos", "element_id", "metadata")
    e = scoring.split_scores(_elements(spark, sf_dir)).join(full, ["doc_id", "pos"]).select("element_id", "type", "text", "metadata", "score")
    s, m = F.col("score"), F.col("metadata")
    got = _written(spark, e, "txt")
    return got.select("element_id", m["element_number"].cast("long").alias("pos"), *[r6(s[c]).alias(c) for c in ("title_condition", "token_condition", "first_listitem_condition", "sum")], s["phrases_condition"].isNull().alias("no_phrases"))


def json_arrays(spark, sf_dir):
    """The elements of a document as one JSON array, read back."""
    e = structure.elements(_docs(spark, sf_dir)).select("doc_id", "pos", "element_id", "type", "text")
    back = F.from_json("json", "array<struct<element_id:string,type:string,text:string>>")
    return io.json_array(e, ["pos"]).select("doc_id", F.posexplode(back).alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), "x.element_id", "x.type", "x.text")


def vector_collection(spark, sf_dir):
    """Vectors inserted in two parts into a collection that was emptied before."""
    path, e = io.scratch(spark, "collection"), table(spark, sf_dir, "embeddings").withColumn("content", F.concat(F.lit("v"), "vec_id"))
    io.VectorCollection(spark, path).insert(e, "content")
    c = io.VectorCollection(spark, path, delete_existing=True)
    for odd in (0, 1):
        c.insert(e.where(F.col("vec_id") % 2 == odd), "content")
    return io.VectorCollection(spark, path).read().select("content", F.size("vector").cast("long").alias("n"), r6(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def pooled_frames(spark, sf_dir):
    """Vectors pooled by label, with the ids of those that went in, in order."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("token"), "embedding")
    p = pooling.pool_frame(e, ["label"], 64, "max")
    return p.select("label", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("h"), r6(F.get("embedding", F.lit(0))).alias("v0"), r6(F.get("embedding", F.lit(63))).alias("v63"))


def text_embeddings(spark, sf_dir):
    """Whole texts embedded, and the distance of each to the next."""
    d = E.HashTextEmbedder(DIM).embed_texts(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return d.select("item_id", *[r6(F.get("embedding", F.lit(k))).alias(f"v{k}") for k in range(DIM)])


class _Spaces:
    """A plug-in tokenizer of the tests: words between spaces; ids are their lengths."""

    def encode(self, text):
        out, at = [], 0
        for w in text.split(" "):
            if w.strip():
                out.append((w, at, at + len(w), len(w)))
            at += len(w) + 1
        return out

    def decode(self, ids):
        return " ".join("x" * i for i in ids)


def plugged_tokenizer(spark, sf_dir):
    """Sentences limited and merged by the tokens of a plug-in; their ids decoded."""
    t = E.FunctionTokenizer(_Spaces)
    m = semantic.merged_sentences(table(spark, sf_dir, "benchmark").select("item_id", "text"), LIMIT, "item_id", tokenizer=t)
    m = m.withColumn("ids", t.ids(F.col("text"))).withColumn("decoded", t.decode(F.col("ids")))
    return m.select("item_id", F.col("sent").cast("long").alias("sent"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("t_start").cast("long").alias("t_start"), F.size("ids").cast("long").alias("n_ids"), F.length("decoded").cast("long").alias("n_decoded"), "text")


def vocabulary_ids(spark, sf_dir):
    """Ids in a vocabulary, and what they decode to without special tokens and tokens outside it."""
    t = E.WordTokenizer(["the", "of", "and", ".", ",", "[SEP]"], ["."])
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.ids(F.col("text")).alias("ids"))
    return d.select("conv_id", "turn", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0), lambda s, x: s + x).cast("long").alias("total"), t.decode(F.col("ids")).alias("decoded"))


QUERIES = {f.__name__: f for f in (text_files, element_metadata, saved_scores, json_arrays, vector_collection, pooled_frames, text_embeddings, plugged_tokenizer, vocabulary_ids)}
QUERIES |= {"saved_txt": _saved("txt"), "saved_json": _saved("json")}

_R = "round({}, 6) + 0.0"
_RAW = ", ".join(f"(('0x' || substr(md5(text || ':{d}'), 1, 8))::BIGINT / 4294967296::DOUBLE * 2 - 1) AS r{d}" for d in range(DIM))
_NORM = "(sqrt(" + " + ".join(f"r{d} * r{d}" for d in range(DIM)) + ") + 1e-8)"
_SAVED = f"WITH {_TYPED} SELECT md5(filename || ':' || pos) AS element_id, type, text, filename, pos, token_size FROM el"
_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')"

ORACLES = {
    "text_files": "SELECT item_id, md5(text || chr(10)) AS h, true AS dated, true AS named, true AS has_id FROM benchmark",
    "element_metadata": f"""WITH {_TYPED} SELECT doc_id, pos, md5(filename || ':' || pos) AS element_id, 1.0::DOUBLE AS detection_class_prob, '2024-01-02T03:04:05' AS last_modified, 'text/plain' AS filetype, NULL::VARCHAR AS parent_id,
      CASE WHEN doc_id % 2 = 0 THEN '.' ELSE 'in' END AS file_directory, filename, 1::BIGINT AS page_number, pos AS element_number, token_size, 'unknown' AS languages, 0::BIGINT AS n_points FROM el""",
    "saved_txt": _SAVED,
    "saved_json": _SAVED,
    "saved_scores": f"""WITH {_SCORED} SELECT md5(doc_id || '.txt:' || pos) AS element_id, pos, {_R.format('t')} AS title_condition, {_R.format('k')} AS token_condition, {_R.format('l')} AS first_listitem_condition,
      {_R.format('score')} AS sum, true AS no_phrases FROM scored""",
    "json_arrays": f"WITH {_TYPED} SELECT doc_id, pos, md5(filename || ':' || pos) AS element_id, type, text FROM el",
    "vector_collection": f"SELECT 'v' || vec_id AS content, len(embedding) AS n, {_R.format('list_sum(embedding::DOUBLE[])')} AS total FROM embeddings",
    "pooled_frames": f"SELECT label, count(*) AS n, md5(string_agg(vec_id::VARCHAR, ' ' ORDER BY vec_id)) AS h, {_R.format('max(embedding[1]::DOUBLE)')} AS v0, {_R.format('max(embedding[64]::DOUBLE)')} AS v63 FROM embeddings GROUP BY label",
    "text_embeddings": f"SELECT item_id, {', '.join(f'''{_R.format(f'r{d} / {_NORM}')} AS v{d}''' for d in range(DIM))} FROM (SELECT item_id, {_RAW} FROM benchmark)",
    "plugged_tokenizer": f"""WITH RECURSIVE words AS (SELECT item_id, sent, list_filter(string_split(sentence, ' '), lambda w: trim(w, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS w FROM ({SENTENCE_SQL.replace('documents', 'benchmark').replace('doc_id', 'item_id')})),
      parts AS MATERIALIZED (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY sent, p) - 1 AS k, w[p + 1 : p + 12] AS w, least(12, len(w) - p) AS c FROM (SELECT *, unnest(range(0, len(w), 12)) AS p FROM words)),
      fold AS (SELECT p.item_id, p.k, p.c AS n, 0::BIGINT AS run FROM parts p WHERE k = 0
        UNION ALL SELECT p.item_id, p.k, CASE WHEN f.n >= 4 OR f.n + p.c > 12 THEN p.c ELSE f.n + p.c END, CASE WHEN f.n >= 4 OR f.n + p.c > 12 THEN f.run + 1 ELSE f.run END FROM fold f JOIN parts p ON p.item_id = f.item_id AND p.k = f.k + 1),
      m AS (SELECT f.item_id, f.run AS sent, sum(p.c)::BIGINT AS n_tokens, flatten(list(p.w ORDER BY p.k)) AS w FROM fold f JOIN parts p ON p.item_id = f.item_id AND p.k = f.k GROUP BY f.item_id, f.run)
      SELECT item_id, sent, n_tokens, (sum(n_tokens) OVER (PARTITION BY item_id ORDER BY sent) - n_tokens)::BIGINT AS t_start, n_tokens AS n_ids, (list_sum(list_transform(w, lambda x: length(x))) + len(w) - 1)::BIGINT AS n_decoded, array_to_string(w, ' ') AS text FROM m""",
    "vocabulary_ids": f"""WITH t AS (SELECT conv_id, turn, {_TOKENS} AS l FROM conversations), i AS (SELECT conv_id, turn, list_transform(l, lambda x: coalesce(list_position(['the', 'of', 'and', '.', ',', '[SEP]'], x), 0) - 1) AS ids FROM t)
      SELECT conv_id, turn, len(ids) AS n, coalesce(list_sum(ids), 0)::BIGINT AS total,
        array_to_string(list_transform(list_filter(ids, lambda x: x >= 0 AND x <> 3), lambda x: ['the', 'of', 'and', '.', ',', '[SEP]'][x + 1]), ' ') AS decoded FROM i""",
}
