"""Documents with everything that an operator must bear: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import pytest

LONG = "Les mots courent vite, and never stop\n" * 6000
ROWS = [
    (1, "Hello world, this is a text.\nAll rights reserved.\n", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (None, "a text without an id\nshared line", "en", None),
    (4, "the same text twice over here", "en", "b"),
    (4, "the same text twice over here", "en", "b"),
    (5, LONG, "fr", "b"),
    (6, " \t\n\r\n  ", "en", "c"),
    (7, "école à l'été, Σ ΑΣ İ <|endoftext|> 日本語 1234!!", "fr", None),
    (8, "THE SAME TEXT TWICE over here", "en", "b"),
    (9, "12345 !!! ...", None, "c"),
]
#: Names that operators use inside or return.
EXTRA = ["ids", "key", "h", "fp", "size", "kept", "n_lines", "row", "bucket", "lang_pred", "text_"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in EXTRA)


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, len(r[1] or ""), *("x" for _ in EXTRA)) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
