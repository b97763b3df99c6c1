"""Column functions on text: cleaning, splitting, tokenizing.  All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence boundary: after one of . ? ! | before white space or the end, or at one or two newlines before text.
SENTENCE = r"(?U)(?<=[.?!|])(?=\s+|\z)|\n{1,2}(?=\S)"
#: Tokens of the default tokenizer: runs of word characters, and single other characters.
TOKEN = r"(?U)\w+|[^\w\s]"
#: The same with the gaps between them.
PIECE = r"(?U)\s+|\w+|[^\w\s]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_ascii(c: Column) -> Column:
    """Delete all but printable ASCII and newlines; three newlines or more become two."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\x20-\x7E\n]", ""), r"\n{3,}", "\n\n")


def clean_line(c: Column) -> Column:
    """One line: no carriage returns, tabs as spaces, newlines as "| ", single spaces."""
    c = F.regexp_replace(F.translate(strip(c), "\t\r", " "), r"\n+", "\n")
    return F.regexp_replace(F.replace(c, F.lit("\n"), F.lit("| ")), r" +", " ")


def sentences(c: Column, regex: str = SENTENCE) -> Column:
    """``array<string>``: the stripped sentences that aren't blank."""
    return F.filter(F.transform(F.split(strip(c), regex), strip), lambda s: s != "")


def lines(c: Column) -> Column:
    """``array<string>``: the stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda s: s != "")


def words(c: Column) -> Column:
    """``array<string>``: lower-case words; characters other than letters, digits, _, - and white space are deleted."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\wÀ-ž\s-]", ""), r"(?U)\s+"), lambda w: w != "")


def token_texts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def count_tokens(c: Column) -> Column:
    return F.size(token_texts(c))


def split_long(c: Column, limit: int) -> Column:
    """``array<string>``: the text itself if it has at most ``limit`` tokens, or else its slices of ``limit`` tokens each, as they
    stand in the text without the gap at their ends."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    piece = rf"(?U)(?:\s*(?:\w+|[^\w\s])){{1,{limit}}}"
    return F.when(count_tokens(c) <= limit, F.array(c)).otherwise(F.transform(F.regexp_extract_all(c, F.lit(piece), F.lit(0)), strip))


def limited_sentences(c: Column, limit: int, regex: str = SENTENCE, tokenizer=None) -> Column:
    if tokenizer:
        return tokenizer.limited(sentences(c, regex), limit)
    return F.flatten(F.transform(sentences(c, regex), lambda s: split_long(s, limit)))


def prefix(c: Column, n: int = 100) -> Column:
    return F.substring(c, 1, n)
