import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segmenta.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_automaton_is_leftmost_for_equal_symbols():
    a = bpe.MergeAutomaton({"a": 0, "b": 1, "aa": 2, "aab": 3}, [("a", "a"), ("aa", "b")])
    assert a.arcs("aaaaa") == ["aa", "aa", "a"]
    assert a.arcs("aaab") == ["aa", "a", "b"]
    assert a.arcs("aab") == ["aab"]


def test_random_merge_lists_agree_with_merging():
    rng = random.Random(3)
    for _ in range(200):
        tokens, merges = list("abc"), []
        for _ in range(8):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        a = bpe.MergeAutomaton({t: k for k, t in enumerate(tokens)}, merges)
        for _ in range(10):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            parts = list(word)
            for u, v in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (u, v):
                        parts[k : k + 2] = [u + v]
                    k += 1
            assert a.arcs(word) == parts, (merges, word)


def test_texts_agree_with_the_library(library):
    rng = random.Random(1)
    letters = "abtheinrou '  \n\tÉéÀñßΣσİ1234.,!?日́̀\x1c\x85  \U0001f600"
    texts = ["", "a\x1cb", "don't STOP'LL", "x<|endoftext|>y <|startoftext|>", "a" * 5000, "ΣΑΣ ὈΔΥΣΣΕΎΣ"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    t, names = bpe.WordTokenizer(PATH), bpe.Labels(PATH)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = t.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert names.decode(got) == library.decode(want, skip_special_tokens=False)


def test_rows(odd, none, small, library):
    for docs in (odd, small):
        found = bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert bpe.digests(bpe.decode(bpe.encode(none, PATH), PATH)).count() == 0


def test_round_trip_is_decode_of_encode(spark, odd, none, small):
    for docs in (odd, none, small):
        want = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
        assert sorted(map(str, bpe.round_trip(docs, PATH).collect())) == sorted(map(str, want))


def test_the_table_is_rebuilt_within_its_bound(monkeypatch):
    t, want = bpe.WordTokenizer(PATH), bpe.WordTokenizer(PATH)
    monkeypatch.setattr(bpe, "TABLE_STATES", 50)
    words = [f"{a}{b}ing" for a in ("th", "é", "qu", "zz") for b in ("an", "oi", "ell", "日")]
    got = [t.automaton.arcs("".join(t.alphabet[x] for x in w.encode())) for w in words * 3]
    monkeypatch.setattr(bpe, "TABLE_STATES", 1 << 20)
    assert got == [want.automaton.arcs("".join(t.alphabet[x] for x in w.encode())) for w in words * 3]
    assert len(t.automaton.step) < 150


def test_memo_stays_within_its_bytes():
    m = bpe.Memo(lambda k: k.encode(), size=10_000)
    for k in range(1000):
        assert m[f"w{k % 300}"] == f"w{k % 300}".encode()
    assert len(m) + len(m.old) <= 100
