import numpy as np
import pyarrow.parquet as pq
import pytest

from segmenta.llm import covertree


def brute(rows, cosine=0.95):
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 3]
    x = np.array([rows[k][1] for k in ok], float).reshape(-1, 3)
    n = np.linalg.norm(x, axis=1)
    hit = (x @ x.T) / np.outer(n, n) >= cosine
    np.fill_diagonal(hit, False)
    links, comp = [0] * len(rows), list(range(len(rows)))
    for a, k in enumerate(ok):
        links[k] = int(hit[a].sum())
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(hit), strict=True):
            m = min(comp[ok[a]], comp[ok[b]])
            for q in (ok[a], ok[b]):
                if comp[q] != m:
                    comp[q], changed = m, True
    ids = {}
    for k, (key, _) in enumerate(rows):
        ids.setdefault(comp[k], []).append(key)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    return sorted(str((rows[k][0], links[k], least[comp[k]], rows[k][0] is not None and rows[k][0] == least[comp[k]])) for k in range(len(rows)))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 3))
    v = [c + rng.normal(size=3) * s for c in centres for s in (0.0, 0.0, 0.02, 0.05, 0.1, 0.3) for _ in range(4)]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [1.0, 2.0], [2e30, 2e30, 2e30], [1e-30, 1e-30, 1e-30]]
    out = [(100 - k, [float(np.float32(y)) for y in x]) for k, x in enumerate(v)]
    out += [(None, out[0][1]), (out[3][0], out[3][1])]  # a null key, a repeated row
    return out + [(1000 + k, x) for k, x in enumerate(odd)]


@pytest.mark.parametrize("block", [7, 4096])
def test_against_brute_force(spark, rows, block):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<float>, node string, mass int")
    got = covertree.near_duplicates(df, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert covertree.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0]["kept"]


def test_traversal_takes_and_drops_nodes_whole():
    rng = np.random.default_rng(2)
    x = covertree.unit(np.concatenate([c + rng.normal(size=(300, 8)) * 0.01 for c in rng.normal(size=(4, 8)) * 3] + [rng.normal(size=(200, 8))]))
    mass = rng.integers(1, 4, len(x))
    half = len(x) // 2
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    own = covertree.dual_traversal(x, mass, covertree.cover_tree(x), None)
    assert (own.links == hit @ mass).all()
    two = covertree.dual_traversal(x, mass, covertree.cover_tree(x, np.arange(half)), covertree.cover_tree(x, np.arange(half, len(x))))
    hit[:half, :half] = hit[half:, half:] = False
    assert (two.links == hit @ mass).all()


def test_lengths_are_linked_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0])]
    got = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == [(1, 1), (1, 1), (1, 3), (1, 3), (0, 5)]


def nodes(node):
    yield node
    for c in node.children:
        yield from nodes(c)


def test_a_tree_is_nested_nets_with_halving_radii():
    rng = np.random.default_rng(4)
    x = covertree.unit(np.concatenate([c + rng.normal(size=(150, 6)) * s for c, s in zip(rng.normal(size=(5, 6)), (0.01, 0.05, 0.1, 0.5, 1.0), strict=True)]))
    root = covertree.cover_tree(x)
    assert root.levels() > 3
    for node in nodes(root):
        d = covertree.distances(x[[node.centre]], x[node.points])[0]
        assert node.centre in node.points and d.max() <= node.radius + 1e-7
        if node.children:
            assert sorted(p for c in node.children for p in c.points) == sorted(node.points)
            assert all(c.radius <= node.radius / 2 + 1e-7 for c in node.children)
            between = covertree.distances(x[node.centres], x[node.centres]) + 9 * np.eye(len(node.centres))
            assert between.min() > node.radius / 2 - 1e-7


def test_the_given_vectors_go_through_the_tree():
    v = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist()
    x = covertree.unit(np.unique(np.array(v, np.float64), axis=0))
    root = covertree.cover_tree(x)
    found = covertree.dual_traversal(x, np.ones(len(x), np.int64), root, None)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    assert root.levels() >= 2 and (found.links == hit.sum(axis=1)).all()
    assert found.compared < 0.01 * len(x) ** 2 / 2  # the bounds decide the rest


def test_clustered_vectors_are_pruned_above_the_leaves():
    rng = np.random.default_rng(6)
    x = covertree.unit(np.concatenate([c + rng.normal(size=(400, 16)) * 0.02 for c in rng.normal(size=(10, 16))]))
    found = covertree.dual_traversal(x, np.ones(len(x), np.int64), covertree.cover_tree(x), None)
    assert found.met + found.compared < 0.1 * len(x) ** 2 / 2


def test_blocks_follow_the_cells():
    first, count = covertree.blocks_of(np.array([3, 4, 0, 5, 30, 1, 2]), 10)
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 5] and count.tolist() == [1, 1, 1, 1, 3, 1, 1]
