"""Embedding near-duplicates by dual traversal of cover trees.

A tree's levels have halving radii: a node covers its points within its radius (measured, so it is exact), and its
children are a net of them at half that radius, however many these are.  Two trees are traversed together.  A pair of nodes is dropped if its centres are
farther apart than both radii and the threshold; it is taken as a whole if even its farthest points link; otherwise
it is opened: the children of one are met with those of the other by one product of their centres, down to leaves, whose points are
compared in double precision.  The metric is the chord between unit vectors: a cosine of c is a chord of sqrt(2 - 2 c).

The upper levels are common to all tasks: pivots, fitted on a bounded sample.  Every vector
goes to the cell of its nearest pivot; cells have exact covering radii, and stand in the order in which a cover tree over the pivots
visits them.  Neighbouring small cells share a block; a cell of more vectors than a block is dealt out by hash.  Pairs of blocks of which no
cells are in reach of each other are never formed.  Each block is written to the shared folder once, and only the numbers of the blocks
of a pair are shuffled, so disk grows with the vectors and not with the pairs.  A pair of blocks gives each vector a
count of links and joins what is linked by spanning stars; pairs of vectors are never listed.  Equal vectors are one point
with a mass."""

from __future__ import annotations

import uuid
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import bounded_batches, dropped, fresh_path, materialise, parts_for
from segmenta.llm.components import connected_components, hook, join
from segmenta.llm.tokenstore import filesystem

THRESHOLD = 0.95
#: Vectors in a block; vectors that the pivots are fitted on; pivots at most; pairs of vectors that a task is given.
BLOCK = 4096
SAMPLE, PIVOTS = 4096, 512
TASK_PAIRS = 1 << 26
#: Pairs of so many neighbouring blocks with as many others are met by one task, which reads each block once.
NEAR_BLOCKS = 4
#: Points in a leaf; points that are offered to a net at once.
LEAF, OFFERED = 8, 256
SLACK = 1e-9
ROWS = 512


def chord(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class Node:
    __slots__ = ("centre", "radius", "points", "children", "centres", "radii")

    def __init__(self, centre: int, radius: float, points: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children
        self.centres, self.radii = np.array([c.centre for c in children], np.int64), np.array([c.radius for c in children])

    def levels(self) -> int:
        return 1 + max((c.levels() for c in self.children), default=0)


def net(x: np.ndarray, points: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a net among ``points``: farther than ``apart`` from each other, and each point within it of one; all points in another order, and the nearest of
    the net for each.  Points are offered in order, many at a time, which makes the work a few matrix products."""
    within, chosen, inner = 1 - apart * apart / 2, points[:1], []  # as a cosine
    for at in range(1, len(points), OFFERED):
        some = points[at : at + OFFERED]
        far = (x[some] @ x[chosen].T).max(axis=1) < within
        some, near = some[far], (x[some[far]] @ x[some[far]].T) >= within
        inner.append(points[at : at + OFFERED][~far])
        new, taken = np.zeros(len(some), bool), np.zeros(len(some), bool)
        for k in range(len(some)):
            if not taken[k]:
                new[k] = True
                taken |= near[k]
        chosen = np.concatenate([chosen, some[new]])
        inner.append(some[~new])
    rest = np.concatenate([*inner, points[:0]])
    of = [(x[rest[at : at + ROWS]] @ x[chosen].T).argmax(axis=1) for at in range(0, len(rest), ROWS)]
    return chosen, np.concatenate([chosen, rest]), np.concatenate([np.arange(len(chosen)), *of])


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, centre: int | None = None) -> Node:
    """The tree over the rows ``points`` of ``x`` (unit vectors)."""
    points = np.arange(len(x)) if points is None else points
    centre = int(points[0]) if centre is None else centre
    radius = float(distances(x[centre : centre + 1], x[points]).max()) if len(points) > 1 else 0.0
    if len(points) <= LEAF or radius <= SLACK:
        return Node(centre, radius, points, [])
    at = np.flatnonzero(points == centre)
    points = np.concatenate([points[at], np.delete(points, at)])  # the centre is in the net
    chosen, points, of = net(x, points, radius / 2)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(chosen) + 1))
    return Node(centre, radius, points, [cover_tree(x, points[order[a:b]], int(c)) for a, b, c in zip(cuts[:-1], cuts[1:], chosen, strict=True)])


class Links:
    """Counts of links by point, weighted by mass, and labels of linked sets."""

    def __init__(self, mass: np.ndarray):
        self.mass, self.links, self.label = mass, np.zeros(len(mass), np.int64), np.arange(len(mass))
        #: Pairs of centres that were met, and pairs of points that were compared in leaves.
        self.met, self.compared = 0, 0

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of ``a`` links with every point of ``b`` (disjoint sets)."""
        self.links[a] += self.mass[b].sum()
        self.links[b] += self.mass[a].sum()
        join(self.label, np.concatenate([a, b]))

    def clique(self, a: np.ndarray) -> None:
        self.links[a] += self.mass[a].sum() - self.mass[a]
        join(self.label, a)

    def compare(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float, own: bool) -> None:
        for at in range(0, len(a), ROWS):
            rows = a[at : at + ROWS]
            cols = b[at:] if own else b
            hit = x[rows] @ x[cols].T >= cosine
            self.compared += hit.size
            i, j = np.nonzero(hit)
            if own:
                later = j > i
                i, j = i[later], j[later]
            i, j = rows[i], cols[j]
            np.add.at(self.links, i, self.mass[j])
            np.add.at(self.links, j, self.mass[i])
            hook(self.label, i, j)


def dual_traversal(x: np.ndarray, mass: np.ndarray, a: Node, b: Node | None, cosine: float = THRESHOLD) -> Links:
    """Links between the trees ``a`` and ``b``, or within ``a``, over the rows of ``x``."""
    out, reach, todo = Links(mass), chord(cosine), [(a, b)]
    while todo:
        a, b = todo.pop()
        if b is None:
            if 2 * a.radius <= reach - SLACK:
                out.clique(a.points)
            elif not a.children:
                out.compare(x, a.points, a.points, cosine, own=True)
            else:
                todo.extend((c, None) for c in a.children if len(c.points) > 1)
                todo.extend(_met(x, out, a, a, reach, own=True))
        elif not a.children and not b.children:
            out.compare(x, a.points, b.points, cosine, own=False)
        else:
            todo.extend(_met(x, out, a, b, reach, own=False))
    return out


def _met(x: np.ndarray, out: Links, a: Node, b: Node, reach: float, own: bool) -> list[tuple[Node, Node]]:
    """Pairs of children of the two nodes that neither bound decides (a leaf, or the smaller of two very unlike nodes, is its own child)."""
    if not own and a.children and b.children and max(a.radius, b.radius) > 2 * min(a.radius, b.radius):
        one, other = ([a], b.children) if a.radius < b.radius else (a.children, [b])
    else:
        one, other = a.children or [a], b.children or [b]
    left, left_radii = (a.centres, a.radii) if one is a.children else (np.array([a.centre]), np.array([a.radius]))
    right, right_radii = (b.centres, b.radii) if other is b.children else (np.array([b.centre]), np.array([b.radius]))
    found, widest = [], float(right_radii.max())
    for at in range(0, len(one), ROWS):
        skip = at if own else 0
        cosines = x[left[at : at + ROWS]] @ x[right[skip:]].T
        out.met += cosines.size
        far = left_radii[at : at + ROWS] + widest + reach + SLACK  # no pair of a row is nearer than this if its cosine is below the bound
        i, j = np.nonzero(cosines >= (1 - far * far / 2)[:, None])
        d, j = np.sqrt(np.maximum(0.0, 2 - 2 * cosines[i, j])), j + skip
        if own:
            i, j, d = i[j > i + at], j[j > i + at], d[j > i + at]
        radii = left_radii[i + at] + right_radii[j]
        kept = d - radii <= reach + SLACK
        i, j, d, radii = i[kept], j[kept], d[kept], radii[kept]
        sure = d + radii <= reach - SLACK
        for k, m, whole in zip((i + at).tolist(), j.tolist(), sure.tolist(), strict=True):
            if whole:
                out.whole(one[k].points, other[m].points)
            else:
                found.append((one[k], other[m]))
    return found


def pivot_order(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of ``x``, each the farthest from those before (a net whose radius falls), in the order in which a cover tree over them visits them."""
    order, near = [0], distances(x[:1], x)[0]
    while len(order) < most and near.max() > SLACK:
        far = int(near.argmax())
        near = np.minimum(near, distances(x[far : far + 1], x)[0])
        order.append(far)
    rows, visited, todo = np.array(order), [], [cover_tree(x[order])]
    while todo:
        node = todo.pop()
        visited.extend(node.points if not node.children else ())
        todo.extend(reversed(node.children))
    return rows[visited]


def blocks_of(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: cells in order share a block while it holds them, and a larger one has blocks of its own."""
    first, count, now, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if used and used + n > block:
            now, used = now + 1, 0
        first[c], count[c] = now, max(1, -(-n // block))
        used += n
        if used >= block:
            now, used = now + int(count[c]), 0
    return first, count


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _write_block(path: str, rows: pa.Table) -> None:
    """One file in the shared folder; it is moved to its place when it is whole, as a task may run twice."""
    fs, name = filesystem(path)
    fs.create_dir(name.rsplit("/", 1)[0])
    part = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f, pa.ipc.new_file(f, rows.schema) as out:
        out.write_table(rows)
    fs.move(part, name)


def _read_block(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Nodes, masses and unit vectors of a block; None if it has no file."""
    fs, name = filesystem(path)
    if fs.get_file_info(name).type == pa.fs.FileType.NotFound:
        return None
    with fs.open_input_file(name) as f:
        rows = pa.ipc.open_file(f).read_all().combine_chunks()
    return rows["node"].to_numpy(), rows["mass"].to_numpy(), unit(_matrix(rows["v"].combine_chunks()))


def link(points: DataFrame, cosine: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(node, root, links)`` from ``points`` (``node long, v array<double or float>, mass long``), all of one length, none
    zero: partial counts of links by node, and a star edge to ``root`` where the node is linked.

    What the driver holds: pivots from a bounded sample, and a size and a radius for each cell."""
    spark = points.sparkSession
    bounded_batches(spark)
    empty = "node long, root long, links long"
    sample = points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], empty)
    x = unit(np.stack(sample["v"].to_numpy()))
    n = points.count()
    sent = spark.sparkContext.broadcast(x[pivot_order(x, min(PIVOTS, 8 * parts_for(n, block)))])

    def cells(batches):
        for b in batches:
            if b.num_rows:
                d = distances(unit(_matrix(b.column(1))), sent.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["node", "v", "mass", "cell", "d"])

    kind = points.schema["v"].dataType.simpleString()
    dealt = materialise(points.select("node", "v", "mass").mapInArrow(cells, f"node long, v {kind}, mass long, cell int, d double"), "cover-cells")
    pivots = len(sent.value)
    sizes, radii = np.zeros(pivots, np.int64), np.zeros(pivots)
    for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect():  # at most PIVOTS rows
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["r"]
    first, count = blocks_of(sizes, block)
    apart = distances(sent.value, sent.value) - radii[:, None] - radii
    near = (apart <= chord(cosine) + SLACK) & (sizes > 0) & (sizes[:, None] > 0)
    total = int((first + count).max())
    reach = np.zeros((total, total), bool)  # blocks of which some cells are near each other; at most pivots and n / block a side
    for c, e in zip(*np.nonzero(near), strict=True):
        reach[first[c] : first[c] + count[c], first[e] : first[e] + count[e]] = True
    info = spark.sparkContext.broadcast(reach)
    at, of = F.array(*[F.lit(int(k)) for k in first]), F.array(*[F.lit(int(k)) for k in count])
    cells_of = dealt
    dealt = dealt.withColumn("block", (F.get(at, F.col("cell")) + F.pmod(F.xxhash64("node"), F.get(of, F.col("cell")))).cast("int"))
    folder = fresh_path(spark, "cover-blocks")

    def written(table: pa.Table) -> pa.Table:
        _write_block(f"{folder}/{table['block'][0].as_py()}.arrow", table.select(["node", "mass", "v"]))
        return pa.table({"rows": pa.array([table.num_rows], pa.int64())})

    dealt.select("block", "node", "mass", "v").groupBy("block").applyInArrow(written, "rows long").agg(F.sum("rows")).collect()  # one row
    dropped(cells_of)

    def pairs(batches):
        for b in batches:
            for me in b.column(0).to_pylist():
                others = np.flatnonzero(info.value[me])
                others = others[others >= me].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), me, np.int32)), pa.array(others)], ["b1", "b2"])

    compared = sum(int(sizes[c]) * int(sizes[near[c]].sum()) for c in range(pivots)) // 2
    met = spark.range(total).mapInArrow(pairs, "b1 int, b2 int").withColumns({"g1": F.floor(F.col("b1") / NEAR_BLOCKS), "g2": F.floor(F.col("b2") / NEAR_BLOCKS)})
    met = met.repartition(parts_for(compared, TASK_PAIRS, spark.sparkContext.defaultParallelism), "g1", "g2").sortWithinPartitions("g1", "g2", "b1", "b2").select("b1", "b2")

    def traverse(batches):
        read = lru_cache(2 * NEAR_BLOCKS)(lambda block: _read_block(f"{folder}/{block}.arrow"))
        for batch in batches:
            for one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, right = read(one), None if one == other else read(other)
                if left is None or (one != other and right is None):  # no vector was dealt to it
                    continue
                node, mass, x = left if right is None else tuple(np.concatenate(p) for p in zip(left, right, strict=True))
                first = len(left[0])
                a = cover_tree(x, np.arange(first))
                b = None if right is None else cover_tree(x, np.arange(first, len(x)))
                found = dual_traversal(x, mass, a, b, cosine)
                k = np.flatnonzero((found.links > 0) | (found.label != np.arange(len(x))))
                yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(node[found.label[k]]), pa.array(found.links[k])], ["node", "root", "links"])

    return met.mapInArrow(traverse, empty)


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors link with those
    of their own length alone.  Rows with equal vectors are linked, repeated rows too.  The
    component of rows without any key is null, and such rows aren't kept.  An empty table gives no rows."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    fit = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    groups = rows.where(fit).groupBy("v").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("mass"))
    points = materialise(groups.withColumn("node", F.monotonically_increasing_id()), "cover-points")
    lengths = [r[0] for r in points.select(F.size("v")).distinct().collect()]  # of the models that made the vectors: few
    found = [link(points.where(F.size("v") == n).select("node", "v", "mass"), cosine, block) for n in sorted(lengths)]
    found = materialise(reduce(DataFrame.unionByName, found, table.sparkSession.createDataFrame([], "node long, root long, links long")), "cover-links")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "node_")
    links = found.groupBy(F.col("node").alias("n")).agg(F.sum("links").alias("links"))
    p = points.join(links, F.col("node") == F.col("n"), "left").join(roots, F.col("node") == F.col("node_"), "left")
    p = p.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("mass") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    p = materialise(p, "cover-roots")
    least = p.groupBy("root").agg(F.min("least").alias("component_id"))
    p = p.join(least, "root").select(F.col("v").alias("w"), "n_links", "component_id")
    linked = rows.where(fit).join(p, F.col("v") == F.col("w")).select("key", "n_links", "component_id")
    alone = rows.where(~fit).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)))
    return out.withColumnRenamed("key", key)
