"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import staged

#: A task contracts so many edges at a time.
EDGES, ROUNDS = 200_000, 60


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges as stars: every node but the least, and the least node of its component."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for i, p in enumerate(parent):  # a parent is less than its child, so it is done already
        parent[i] = parent[p]
    root = np.array(parent, dtype=np.int64)
    some = root != np.arange(len(root))
    return nodes[some], nodes[root[some]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to stars, about EDGES at a time; where rows come by u, those of one u stay together."""
    us, vs, held = [], [], 0

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["u", "v"])

    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        held += len(batch)
        if held >= EDGES:
            u, v = np.concatenate(us), np.concatenate(vs)
            ends = np.flatnonzero(u[1:] != u[:-1])
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield out(u[:cut], v[:cut])
            us, vs, held = [u[cut:]], [v[cut:]], len(u) - cut
    if held:
        yield out(np.concatenate(us), np.concatenate(vs))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Rounds of two steps over links from a node to a lesser one. Contraction: each task makes stars of the links that it
    holds, before the shuffle by node and after it; so of a node with very many lesser neighbours one link leaves a task,
    and links from a node to several others become one, and links among these. Jump: a node's link to one that has a
    link itself moves on to where that leads; this is the one join that a node with very many greater neighbours takes
    part in, between two stored tables, one row a node on the other side, so Spark splits its rows as it finds them.
    Rounds are stored in the shared folder, so none is computed twice and none is lost with an executor. Their number
    grows with the logarithm of the longest path; raises if ROUNDS don't reach the end.
    """
    links = edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u <> v")
    before = None
    for n in range(ROUNDS):
        dealt = links.mapInArrow(_contract, "u bigint, v bigint").repartition("u").sortWithinPartitions("u")
        stars = staged(dealt.mapInArrow(_contract, "u bigint, v bigint"), f"components-{n}-stars")
        best = staged(stars.groupBy("u").agg(F.min("v").alias("v")), f"components-{n}-best")
        on = best.select(F.col("u").alias("v"), F.col("v").alias("w"))
        links = staged(stars.join(on.hint("merge"), "v", "left").select("u", F.coalesce("w", "v").alias("v")), f"components-{n}")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    # a forest of stars: every other node points at the least of its component
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
