import random
import re

import numpy as np
import xxhash

from segmenta.llm import simhash
from segmenta.llm.components import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, linked):
    comp = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for a in range(len(items)):
            for b in range(a):
                if comp[a] != comp[b] and linked(items[a], items[b]):
                    comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
                    changed = True
    return comp


def check(rows, got):
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    want = sorted(str((rows[k][0], f"{fps[k]:016x}", least[comp[k]])) for k in range(len(rows)))
    assert sorted(str(tuple(r)) for r in got) == want


def test_rows(odd, none, small):
    for docs in (odd, small):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        check(rows, simhash.digests(simhash.near_duplicates(docs, tile=64)).collect())
    assert simhash.near_duplicates(none).count() == 0


def test_tiles_against_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(4)] + [0, (1 << 64) - 1, 15, 31]
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in [*signed, signed[0]]], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.link(df, tile=16)).collect()}
    comp = groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for a in range(len(fps)):
        for b in range(a):
            assert (roots.get(signed[a], signed[a]) == roots.get(signed[b], signed[b])) == (comp[a] == comp[b])


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(500, 500), (None, 3), (601, 600), (601, 600)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 500: 500, 600: 600, 601: 600}
