"""Connected components of an edge table, without gathering edges or labels anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import dropped, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the smallest node reachable.

    Each round hooks every node to the smallest of its neighbours and itself (a minimum,
    so it is combined before the shuffle), jumps pointers twice, and contracts the edges;
    components shrink geometrically and rounds are few.  Every round is written to the shared folder, so
    lineage stays short.  Loops and repeated edges are harmless; edges with a null end are ignored; an
    empty table gives no rows."""
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    nodes = materialise(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "cc-nodes")
    e = materialise(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    while not e.isEmpty():
        done = [nodes, e]  # tables that nothing reads after the round
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        for _ in range(2):
            up = materialise(up, "cc-up")
            done.append(up)
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            up = up.join(over, "up").select("node", F.col("over").alias("up"))
        up = materialise(up, "cc-up")
        done.append(up)
        nodes = materialise(
            nodes.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "cc-nodes"
        )
        e = e.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        e = materialise(e.where("ua <> ub").select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct(), "cc-edges")
        for table in done:
            dropped(table)
    dropped(e)
    return nodes


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join what the pairs ``(i, j)`` link in ``label``, an array that gives each item the smallest item of its set."""
    while len(i):
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        if len(i):
            join(label, np.append(j[i == i[0]], i[0]))


def join(label: np.ndarray, items: np.ndarray) -> None:
    """Make one set of the sets of ``items``."""
    met = np.unique(label[items])
    if len(met) > 1:
        label[np.isin(label, met)] = met[0]
