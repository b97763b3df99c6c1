import random

from segmenta.llm import licenses

MIT = licenses.TEMPLATES["MIT"][1]


def test_spans_and_edits():
    s = licenses.Scanner()
    text = "Some text.\nReleased under the MIT License.\nmore"
    assert s.scan(text) == [("MIT", 0, 1.0, 5, 11, 41)]
    words = MIT.split()
    del words[20:23]
    words[40:40] = ["really", "two"]
    words[60] = "changed"
    edited = "Header line here. " + " ".join(words) + " Footer."
    (name, n, coverage, matched, start, end), *rest = s.scan(edited)
    assert (name, n) == ("MIT", 1) and not rest and 0.9 < coverage < 1 and edited[start:].startswith("Permission is hereby") and edited[:end].endswith("of the Software")
    assert s.scan("the license is a word, and rights are reserved by all") == []


def test_every_template_is_found_alone():
    s = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for n, t in enumerate(texts):
            assert (name, n, 1.0) in [r[:3] for r in s.scan(f"Before it. {t} After it.")]


def test_adjacent_repeats_are_all_found():
    s = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for n, t in enumerate(texts):
            for times in (2, 3, 7):
                for between in (" ", "\n", " and "):
                    got = s.scan(between.join([t] * times))
                    assert [r[:3] for r in got] == [(name, n, 1.0)] * times
                    assert [r[4] for r in got] == [k * len(t + between) for k in range(times)]


def test_neighbouring_licenses_are_told_apart():
    s = licenses.Scanner()
    names = lambda t: [r[0] for r in s.scan(f"Before it. {t} After it.")]
    gpl, cc = "This work is licensed under the GNU {} License, version {}.", "This work is licensed under a Creative Commons Attribution{} {} International License."
    assert names(gpl.format("General Public", 2)) == ["GPL-2.0"] and names(gpl.format("General Public", 3)) == ["GPL-3.0"]
    assert names(gpl.format("Lesser General Public", 3)) == ["LGPL-3.0"] and names(gpl.format("General Public", 1)) == []
    assert names("Creative Commons Attribution 4.0 International License") == []
    assert names(gpl.format("Lesser General Public", 2)) == []
    for middle, name in (("", "CC-BY-4.0"), ("-NonCommercial", "CC-BY-NC-4.0"), ("-ShareAlike", "CC-BY-SA-4.0"), ("-NonCommercial-ShareAlike", "CC-BY-NC-SA-4.0")):
        assert names(cc.format(middle, "4.0")) == [name] and names(cc.format(middle, "3.0")) == []
    assert names(licenses.TEMPLATES["BSD-3-Clause"][0]) == ["BSD-3-Clause"] and names(licenses.TEMPLATES["BSD-2-Clause"][0]) == ["BSD-2-Clause"]
    assert names("Licensed under the Apache License, Version 1.1.") == [] and names("Released under the ISC License.") == ["ISC"]


def test_brute_force_over_the_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r["doc_id"], r["license"], r["span_start"], r["span_end"]) for r in licenses.scan(docs).collect())
    want = []
    for r in docs.collect():
        for name, texts in licenses.TEMPLATES.items():
            t = texts[0].rstrip(".")
            at = r["text"].find(t)
            while at >= 0:
                want.append((r["doc_id"], name, at, at + len(t)))
                at = r["text"].find(t, at + 1)
    assert got == sorted(want)


def test_rows(odd, none):
    got = licenses.scan(odd).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(1, "all-rights-reserved")]
    assert licenses.scan(none).count() == 0


def common_words(a, b):
    """Words of the longest common subsequence, over all of both."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_edited_texts_against_an_exhaustive_alignment():
    rng, s = random.Random(8), licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for n, t in enumerate(texts):
            template = licenses.words_of(t)
            spots = [k for k in range(5, len(template) - 5, 9) if template[k] not in licenses.TELLING and not template[k].isdigit()]
            for _ in range(3):
                words = []
                chosen = set(rng.sample(spots, len(spots) // 2))
                for k, w in enumerate(template):
                    kind = rng.choice(["change", "add", "drop"]) if k in chosen else None
                    words += {"change": ["zzz"], "add": [w, "zzz"], "drop": []}.get(kind, [w])
                filler = ["qqq"] * rng.randint(1, 30)
                text = " ".join(filler + words + filler + words + filler)
                got = s.scan(text)
                assert [r[:2] for r in got] == [(name, n)] * 2, (name, n, got)
                assert [r[3] for r in got] == [common_words(template, words)] * 2
                assert all(text[a:b].split()[0] == words[0] and text[a:b].split()[-1] == words[-1] for *_, a, b in got)
