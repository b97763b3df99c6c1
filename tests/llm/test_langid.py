import numpy as np
from pyspark.sql import functions as F

from segmenta.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_rows(odd, none, small):
    filters = langid.fit(small)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd, filters).collect()]
    assert len(got) == 11 and all(0 <= s <= 1 for _, _, s in got)
    by = {}
    for i, p, s in got:
        by.setdefault(i, []).append((p, s))
    assert by[2] == by[3] == by[6] == by[9] == [("und", 0.0)]
    assert len(by[4]) == 2 and by[4][0] == by[4][1]
    assert langid.predict(none, filters).count() == 0
    empty = langid.fit(none)
    assert empty.langs == [] and {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}


def test_filters_hold_what_they_were_given():
    rng = np.random.default_rng(1)
    grams = [rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(3)]
    f = langid.Filters.build(["a", "b", "c"], grams, bits=1 << 16)
    for k, g in enumerate(grams):
        assert ((f.masks(g)[:, 0] >> k) & 1 == 1).all()
    wrong = (f.masks(rng.integers(0, 1 << 63, 20000, dtype=np.uint64))[:, 0] & 1).mean()
    assert abs(wrong - f.false_rate[0]) < 0.01


def by_sets(langs, grams, text):
    """The prediction with a set of n-grams for each language in place of its filter: shares of the text's n-grams."""
    low = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    if not any(c.isalpha() for c in text):
        return None
    found = [low[k : k + langid.N] for k in range(len(low) - langid.N + 1) if low[k : k + langid.N].strip()]
    codes = [np.array([ord(c) for c in g], np.uint32) for g in found]
    hashes = [int(langid._grams(c, langid.N)[0]) for c in codes]
    return [sum(h in g for h in hashes) / max(1, len(hashes)) for g in grams]


def test_predictions_against_sets(spark, small, monkeypatch):
    kept = {}
    build = langid.Filters.build.__func__

    def remember(cls, langs, grams, n=langid.N, **options):
        kept.update(langs=langs, grams=[set(g.tolist()) for g in grams])
        return build(cls, langs, grams, n, **options)

    monkeypatch.setattr(langid.Filters, "build", classmethod(remember))
    filters = langid.fit(small.where(~langid.held_out()))
    texts = [r["text"] for r in small.select("text").collect()] + ["", "123 !", "a", "ab cd", "Ärger über Öl", None]
    for text, (lang, score) in zip(texts, filters.predict(texts), strict=True):
        shares = by_sets(kept["langs"], kept["grams"], text or "")
        if shares is None:
            assert (lang, score) == ("und", 0.0)
            continue
        assert abs(score - shares[kept["langs"].index(lang)]) < 0.03  # the filters' false positives, beyond their mean
        if sorted(shares)[-1] - sorted(shares)[-2] > 0.06:
            assert lang == kept["langs"][int(np.argmax(shares))]


def test_more_languages_than_bits_of_a_word():
    rng = np.random.default_rng(2)
    words = [["".join(chr(97 + x) for x in rng.integers(0, 26, 8)) for _ in range(30)] for _ in range(70)]
    grams = []
    for w in words:
        a, _ = langid._codes([" ".join(w)])
        grams.append(np.unique(langid._grams(a, langid.N)[langid._informative(a, langid.N)]))
    f = langid.Filters.build([f"l{k:02}" for k in range(70)], grams, bits=1 << 16)
    assert [p for p, _ in f.predict([" ".join(w[:20]) for w in words])] == f.langs


def test_a_rare_label_does_not_take_a_language_over(spark, small):
    docs = small.where("lang = 'en'").orderBy(F.desc("n_chars")).limit(1).select("doc_id").first()[0]
    wrong = small.withColumn("lang", F.when(F.col("doc_id") == docs, "xx").otherwise(F.col("lang")))
    found = langid.predict(small.where("lang = 'en'").where(F.col("doc_id") != docs), langid.fit(wrong))
    assert found.where("lang_pred = 'xx'").count() <= 0.02 * found.count()
