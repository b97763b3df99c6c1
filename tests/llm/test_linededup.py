import hashlib
import re
from collections import Counter

import pytest

from segmenta.llm import linededup


def slow(rows, min_docs, min_chars=1):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and counts[key(x)] >= min_docs)]
        out.append(str((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("bound", [1 << 20, 0])  # by a set in every task, and by a join
@pytest.mark.parametrize("min_chars", [1, 30])
def test_rows(odd, none, small, bound, min_chars):
    for docs, least in ((odd, 2), (small, 4)):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = linededup.drop_frequent_lines(docs, min_docs=least, min_chars=min_chars, broadcast_bytes=bound)
        assert set(docs.columns) <= set(got.columns)
        assert sorted(str(tuple(r)) for r in linededup.digests(got).collect()) == slow(rows, least, min_chars)
    assert linededup.drop_frequent_lines(none, broadcast_bytes=bound).count() == 0


def test_in_place(odd):
    got = {(r["doc_id"], r["text"]) for r in linededup.drop_frequent_lines(odd, out="text", min_docs=2).collect()}
    assert (8, "") in got and (4, "") in got
