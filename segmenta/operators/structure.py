"""Lines of text as typed elements: Title, ListItem, NarrativeText."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.functions import text as T

# Fixed values of the element file.
LANGUAGES = ["unknown"]
PAGE = 1
FILETYPE = "text/plain"
CLASS_PROB = 1.0

_ROMAN = r"(?i)^(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)$"


def list_candidate(line: Column) -> Column:
    """A bullet; digits or one letter before . or ); digits with or without brackets; or a roman numeral from i to x alone."""
    return line.rlike(r"^[-*+]") | line.rlike(r"^\d+[.)]") | line.rlike(r"^[a-zA-Z][.)]") | line.rlike(r"^[(\[{]?\d+[)\]}]?") | line.rlike(_ROMAN)


def numeric_prefix(line: Column) -> tuple[Column, Column]:
    """Number (null if there is none) and suffix of dots and letters."""
    digits = F.regexp_extract(line, r"^(\d+)([.a-z]*)", 1)
    return F.when(digits != "", digits.cast("decimal(38,0)")), F.regexp_extract(line, r"^(\d+)([.a-z]*)", 2)


def follows(n1: Column, s1: Column, n2: Column, s2: Column, dotted: bool = False) -> Column:
    """Whether the second prefix comes after the first: the next number with no suffix (or, ``dotted``, a lone dot), or the next letter."""
    letter = lambda s: s.rlike(r"^[a-z]$")
    plain = (s2 == "") | (s2 == ".") if dotted else s2 == ""
    next_number = (n2 == n1 + 1) & plain
    next_letter = letter(s1) & letter(s2) & (F.ascii(s2) - F.ascii(s1) == 1)
    return F.coalesce(n1.isNotNull() & n2.isNotNull() & (next_number | next_letter), F.lit(False))


def classified(lines: DataFrame, key: str = "doc_id", line: str = "text", pos: str = "pos", dotted_lists: bool = False) -> DataFrame:
    """Lines with ``type``.  A list candidate is a ListItem if a neighbour is a candidate and, for a line with a number, comes before or
    after it in the count.  A NarrativeText with six points or more is a Title: 3 for 5 to 50 characters, 2 for title or upper
    case, 1 for no NarrativeText beside it, 1 for no full stop at its end, 3 for a longer line next."""
    w = Window.partitionBy(key).orderBy(pos)
    n, s = numeric_prefix(F.col(line))
    d = lines.withColumn("cand", list_candidate(F.col(line))).withColumn("n", n).withColumn("s", s)
    near = lambda c, k: F.lag(c, k).over(w)
    before = near("cand", 1) & (F.col("n").isNull() | follows(near("n", 1), near("s", 1), F.col("n"), F.col("s"), dotted_lists))
    after = near("cand", -1) & (F.col("n").isNull() | follows(F.col("n"), F.col("s"), near("n", -1), near("s", -1), dotted_lists))
    item = F.col("cand") & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    d = d.withColumn("type", F.when(item, "ListItem").otherwise("NarrativeText")).drop("cand", "n", "s")
    t = F.col(line)
    title_case = t.rlike("[A-Za-z]") & ~t.rlike("[A-Za-z][A-Z]") & ~t.rlike("(?<![A-Za-z])[a-z]")
    upper_case = t.rlike("[A-Z]") & ~t.rlike("[a-z]")
    no_text = lambda k: F.coalesce(near("type", k) != "NarrativeText", F.lit(True))
    points = (
        F.when(F.length(t).between(5, 50), 3).otherwise(0)
        + F.when(title_case | upper_case, 2).otherwise(0)
        + F.when(no_text(1) & no_text(-1), 1).otherwise(0)
        + F.when(~t.rlike(r"[.!?]\z"), 1).otherwise(0)
        + F.when(F.coalesce(F.length(near(line, -1)) > F.length(t), F.lit(False)), 3).otherwise(0)
    )
    d = d.withColumn("points", points)
    return d.withColumn("type", F.when((F.col("type") == "NarrativeText") & (F.col("points") >= 6), "Title").otherwise(F.col("type")))


def line_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", clean: bool = True) -> DataFrame:
    """``(key, pos, text)`` with the other columns: the lines that aren't blank, numbered from 0."""
    c = T.clean_ascii(F.col(text)) if clean else F.col(text)
    others = [x for x in docs.columns if x not in (text, "pos")]
    return docs.select(*others, F.posexplode(T.lines(c)).alias("pos", "text"))


def elements(docs: DataFrame, key: str = "doc_id", text: str = "text", filename: Column | None = None, directory: Column | None = None, last_modified: Column | None = None, **options) -> DataFrame:
    """``(key, type, element_id, text, metadata)``: the element rows of each text.  The id is the md5 of file name and number."""
    name = filename if filename is not None else F.concat(F.col(key).cast("string"), F.lit(".txt"))
    d = docs.select(key, F.col(text).alias("text"), name.alias("filename"), (directory if directory is not None else F.lit(".")).alias("file_directory"), (last_modified if last_modified is not None else F.lit("")).alias("last_modified"))
    d = classified(line_rows(d, key, "text"), key, **options)
    coordinates = F.struct(F.array().cast("array<array<double>>").alias("points"))
    metadata = F.struct(
        F.lit(CLASS_PROB).alias("detection_class_prob"),
        coordinates.alias("coordinates"),
        "last_modified",
        F.lit(FILETYPE).alias("filetype"),
        F.array(*[F.lit(x) for x in LANGUAGES]).alias("languages"),
        F.lit(PAGE).alias("page_number"),
        F.lit(None).cast("string").alias("parent_id"),
        "file_directory",
        "filename",
        F.col("pos").alias("element_number"),
        T.count_tokens(F.col("text")).alias("token_size"),
    )
    return d.select(key, "pos", "type", F.md5(F.concat_ws(":", "filename", "pos")).alias("element_id"), "text", metadata.alias("metadata"))
