"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combine and two joins, so a hub never has its
neighbours gathered in one task; AQE splits skewed join partitions. A graph whose edges, counted first,
are at most ``ONE_TASK`` (16 bytes each) is solved in one task instead, as a dozen rounds of
shuffles would cost more than the work; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lakewright.storage import cut

#: Edges up to which one task labels the graph.
ONE_TASK = 1_000_000


def label(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, component of each) of the edges: least labels are hooked along edges, then pointers are jumped."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts)
        nodes, component = label(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        yield pd.DataFrame({"node": nodes, "component": component})

    kind = pairs.schema["u"].dataType
    return pairs.coalesce(1).mapInPandas(run, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; component is the least node reachable.

    Null ends and self-loops carry no link; a node with only a self-loop is its own component.
    Empty input gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs = cut(pairs.distinct(), "cc")
    if pairs.count() <= ONE_TASK:
        return _in_one_task(pairs)
    loops = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    now, seen = pairs.where("u <> v"), None
    for _ in range(rounds):
        now = cut(_small_star(_large_star(now)).where("u <> v").distinct(), "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return ends.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
