"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the given edges connect."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """node and root (the least node it is connected with) of every node that has an edge.

    edges: a, b (long). Large-star and small-star steps alternate until nothing changes, in
    about log(nodes) rounds; minima are partly aggregated before they are exchanged, and each
    round is written as a table, so lineage stays short and no component meets in one place.
    """
    now = ws.table("edges", edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, turn = _mark(now), 0
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        large = ws.table("large", large)
        if turn:
            ws.drop("star")  # of the round before, which large was made from
        turn += 1
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        nxt = ws.table("star", small.distinct())
        ws.drop("large")
        changed = _mark(nxt)
        now, same, mark = nxt, changed == mark, changed
        if same:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and a digest of a set of edges."""
    n, x = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return n, x


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each made longer until no column (in whatever case) has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_of_each(ws: Workspace, docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs of one text of each root: that of the smallest doc_id.

    found: doc_id, node (xxhash64 of the text, null as empty) and root of every row with a
    doc_id. One of equal rows stays; rows without a doc_id all stay. Other columns of docs may
    have any name.
    """
    found = found.groupBy("doc_id", "node").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("times"))
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "node", "times")).alias("k"))
    own_id, own_node, text = free_names(docs.columns, "kept_id", "kept_node", "text_node")
    kept = ws.table("kept", kept.select(F.col("k.doc_id").alias(own_id), F.col("k.node").alias(own_node), F.col("k.times").alias("times")))
    # one plan at every size: the kept ids grow with the input and are never broadcast
    node = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    same = (F.col("doc_id").cast("long") == F.col(own_id)) & (node == F.col(own_node))
    out = docs.join(kept.select(own_id, own_node).hint("merge"), same, "left_semi")
    if kept.filter("times > 1").limit(1).count():
        out = out.withColumn(text, node).dropDuplicates(["doc_id", text]).drop(text)
    return out.unionByName(docs.filter("doc_id IS NULL"))
