import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from segmenta.llm import lm


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


def slow(rows):
    uni, pairs, histories = Counter(), Counter(), Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            uni.update(w)
            pairs.update(zip(["S", *w[:-1]], w, strict=True))
            histories.update(["S", *w[:-1]])
    n, v, out = sum(uni.values()), len(uni), []
    p = lambda x: (uni[x] + 0.1) / (n + 0.1 * (v + 1))
    for i, t in rows:
        w = tokens(t)
        score = sum(math.log10((pairs[u, x] + lm.PRIOR * p(x)) / (histories[u] + lm.PRIOR)) for u, x in zip(["S", *w[:-1]], w, strict=True))
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), score))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [1 << 11, 1 << 24])
def test_rows(odd, small, bucket):
    for docs in (odd, small):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        found = lm.score(docs, ~lm.held_out(), bucket_bytes=bucket).collect()
        got = sorted(((r["doc_id"], not r["training"], *tuple(r)[2:]) for r in found), key=str)
        for a, b in zip(sorted(got, key=lambda r: str(r[:5])), sorted(slow(rows), key=lambda r: str(r[:5])), strict=True):
            assert a[:5] == b[:5]
        assert sorted(r[5] for r in got) == pytest.approx(sorted(r[5] for r in slow(rows)))
        assert sorted(r[6] for r in got) == pytest.approx(sorted(r[6] for r in slow(rows)))


def test_probabilities_add_up():
    b = lm.Bucket(["a b a c", "b a"], np.array([True, True]))
    words = sorted({*"abc"})
    for history in ["a", "b", "zzz"]:
        mass = 0.0
        for w in [*words, "unseen"]:
            c = lm.Bucket(["a b a c", "b a", f"{history} {w}"], np.array([True, True, False]))
            a = lm.BackoffAutomaton(c, 8, 4)
            mass += 10 ** a.weights[-2]
        c = lm.Bucket(["a b a c", "b a", history], np.array([True, True, False]))
        mass += 10 ** lm.BackoffAutomaton(c, 8, 4).weights[-1]
        assert mass == pytest.approx(1.0)
    assert b.words.counts.sum() == 10  # eight tokens, two starts


def test_packing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)) * np.uint64(2)
    counts = rng.integers(0, 1 << 20, len(keys))
    k, c = lm.unpack(*lm.pack(keys, counts))
    assert (k == keys).all() and (c == counts).all()


def test_empty(none):
    assert lm.scored(none).count() == 0
