"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one aggregate, written to the shared folder, and one equi-join of two tables there: no
aggregate shares the join's shuffle, so adaptive execution can split a node with very many links. Nothing is
collected but a row of three numbers a round, the count of the distinct links and two hashes of them joined
by exclusive or, which any order and any ids give alike: they tell whether the table still changes.

Up to SMALL distinct links, a count that is taken first, are 16 MB: one task finishes those in one pass. The
result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import Scratch

#: Links that one task may finish.
SMALL = 1 << 20


def _star(scratch: Scratch, edges: DataFrame, name: str, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: every node links its larger neighbours to the least one; small: its smaller ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
    if large:
        # A larger neighbour b of a is, in the table as stored, a row (b, a).
        linked = edges.select(F.col("a").alias("v"), F.col("b").alias("a")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = scratch.save(linked.where("a != b").distinct(), name)
    scratch.drop(f"{name}-least")
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the component of each): roots hook onto smaller roots, then all paths are cut short."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(p[apart], q[apart]), np.minimum(p[apart], q[apart]))
        while not np.array_equal(short := root[root], root):
            root = short


def _finish(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        nodes, least = labels(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])


def components(scratch: Scratch, links: DataFrame, name: str, rounds: int = 100, small: int | None = None) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-0")
    mark, i = _mark(edges), 0
    while mark[0] > (SMALL if small is None else small):
        old = f"{name}-{i}"
        middle = _star(scratch, edges, f"{name}-{i}m", True)
        edges = _star(scratch, middle, f"{name}-{i + 1}", False)
        scratch.drop(old, f"{name}-{i}m")
        i, before, mark = i + 1, mark, _mark(edges)
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        if i >= rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return scratch.save(edges.coalesce(1).mapInArrow(_finish, "node long, component long"), f"{name}-nodes")


def forest(links, ids):
    """(node, least node of its group) for the nodes that a square boolean matrix of links joins to others."""
    n, out = len(ids), []
    left = links.any(axis=1)
    while left.any():
        first = int(np.argmax(left))
        front, group = np.array([first]), [first]
        left[first] = False
        while len(front):
            front = np.flatnonzero(links[front].any(axis=0) & left)
            left[front] = False
            group.extend(front.tolist())
        got = ids[np.array(group)]
        out.append((got, np.full(len(got), got.min())))
    if not out:
        return ids[:0], ids[:0]
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = a != b
    return a[keep], b[keep]
