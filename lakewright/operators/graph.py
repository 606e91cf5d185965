"""Edges, degrees, neighbourhoods and lineage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.functions.text import normal_id
from lakewright.storage import cut

#: Sets of groups that go to the tasks at once, and those compared with them at a time.
SIGNATURES, AT_ONCE = 16_384, 64


def reverse(edges: DataFrame) -> DataFrame:
    """The reverse relation, as a view."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def lineage(models: DataFrame) -> DataFrame:
    """(src parent, dst child, relation) by name of the base; self-loops and unknown bases go."""
    ids = models.select(F.col("id").alias("src"), normal_id(F.col("name")).alias("k"))
    child = models.where("base is not null").select(F.col("id").alias("dst"), normal_id(F.col("base")).alias("k"), "relation")
    return child.join(ids, "k").where("src <> dst").select("src", "dst", "relation")


def hub_stats(edges: DataFrame) -> DataFrame:
    """Children of parents: number of parents, index quantiles of the counts, most, over 1000."""
    n = edges.groupBy("src").agg(F.count("*").alias("n"))
    pick = lambda p: F.element_at("c", (F.floor(F.lit(p) * (F.size("c") - 1)) + 1).cast("int")).alias(f"p{int(100 * p)}")
    # counts repeat: the sorted array holds one entry a parent through (count, parents) pairs, so it stays small
    hist = n.groupBy("n").agg(F.count("*").alias("k"))
    up = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.sum("k").over(up))
    total = n.agg(F.count("*").alias("parents"), F.max("n").alias("most"), F.count_if(F.col("n") > 1000).alias("over_1000"))
    q = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("parents") - 1)), F.col("n"))).alias(f"p{round(100 * p)}")
    return cum.join(total).groupBy("parents", "most", "over_1000").agg(q(0.5), q(0.9), q(0.99))


def degree_cap(edges: DataFrame, q: float = 0.95) -> DataFrame:
    """Each source's heaviest edges, as many as the q-quantile of degrees, rounded up."""
    deg = edges.groupBy("src").agg(F.count("*").alias("d"))
    cap = deg.agg(F.ceil(F.percentile("d", F.lit(q))).alias("cap"))
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return edges.withColumn("_r", r).join(cap).where("_r <= cap").drop("_r", "cap")


def symmetric_top(edges: DataFrame, k: int = 10) -> DataFrame:
    """Edges and their reverses, the heavier of repeats, then the k heaviest of each source."""
    both = edges.select("src", "dst", "w").unionByName(reverse(edges.select("src", "dst", "w"))).groupBy("src", "dst").agg(F.max("w").alias("w"))
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return both.withColumn("rank", r).where(F.col("rank") <= k)


def closure(
    seeds: DataFrame, edges: DataFrame, hops: int, fan_out: int | None = None, order: Column | None = None
) -> DataFrame:
    """(seed, node, hop): all nodes within ``hops`` of each seed, with the first hop; fan-out by a hash order of the edges.

    ``seeds``: (seed, node), where the closures begin.
    """
    edges = edges.select("src", "dst") if order is None else edges.select("src", "dst", order.alias("_o"))
    if fan_out is not None:
        hashed = F.md5(F.concat_ws(":", "src", "dst")) if order is None else F.col("_o")
        r = F.row_number().over(Window.partitionBy("src").orderBy(hashed, "dst"))
        edges = edges.withColumn("_r", r).where(F.col("_r") <= fan_out)
    seen = seeds.select("seed", "node").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        last = seen.where(F.col("hop") == h - 1)
        near = last.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(h).alias("hop"))
        seen = seen.unionByName(near).groupBy("seed", "node").agg(F.min("hop").alias("hop"))
    return seen


def pair_weights(edges: DataFrame, how: str) -> DataFrame:
    """(src, dst, w): repeated pairs become one, by their largest or mean weight."""
    agg = {"max": F.max, "mean": F.avg}[how]
    return edges.groupBy("src", "dst").agg(agg("w").alias("w"))


def neighbour_mean(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(src, pos, value): the weighted mean of the neighbours' vectors, by position."""
    at = vectors.select(F.col("item").alias("dst"), F.posexplode("v").alias("pos", "x"))
    return edges.join(at, "dst").groupBy("src", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("value"))


def known_low(edges: DataFrame, low: float = 0.3, least: int = 3, top: float = 0.1) -> DataFrame:
    """(src, dst): weights at or below the low quantile of their dataset, of datasets with ``least`` edges or more.

    Positives, the top fraction of the dataset (one at least, halves to even), are left out.
    """
    q = edges.groupBy("dst").agg(F.percentile("w", F.lit(low)).alias("q"), F.count("*").alias("n")).where(F.col("n") >= least)
    below = edges.join(q, "dst").where("w <= q").select("src", "dst")
    return below.join(positives(edges, top), ["src", "dst"], "left_anti")


def positives(edges: DataFrame, top: float = 0.1) -> DataFrame:
    """(src, dst): the top fraction of each dataset's models, one at least; ties to the smaller model."""
    by = Window.partitionBy("dst")
    r = edges.withColumn("k", F.row_number().over(by.orderBy(F.desc("w"), "src"))).withColumn("n", F.count("*").over(by))
    return r.where(F.col("k") <= F.greatest(F.lit(1.0), F.bround(top * F.col("n"), 0))).select("src", "dst")


def incompatible(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(dst, n): how many observed models have no edge of the dataset's task; datasets of task 0 (other) have none.

    ``tasks``: (dst, task). Counted by the models that do have one, so no pair of model and dataset is made.
    """
    held = edges.join(tasks, "dst").select("src", "task").distinct()
    have = held.groupBy("task").agg(F.count("*").alias("have"))
    n = edges.agg(F.countDistinct("src").alias("models"))
    used = edges.select("dst").distinct().join(tasks, "dst").where("task <> 0").join(have, "task").crossJoin(F.broadcast(n))
    return used.select("dst", (F.col("models") - F.col("have")).alias("n"))


def peers(edges: DataFrame) -> DataFrame:
    """(m, peers): how many other members share a group with each member that shares one; ``edges``: (m, d), members and groups.

    Members with equal sets of groups are one row with a count; sets are compared as bits, SIGNATURES at a time with all of
    them, so no pair of members is made. Null members and groups share nothing.
    """
    held = edges.where("m is not null and d is not null").groupBy("m").agg(F.sort_array(F.collect_set("d")).alias("s"))
    held = cut(held, "held")
    kinds = cut(held.groupBy("s").agg(F.count("*").alias("n")), "kinds")
    blocks = max(1, -(-kinds.count() // SIGNATURES))

    def of(block: DataFrame) -> DataFrame:
        rows = block.collect()  # SIGNATURES rows about
        place = {d: i for i, d in enumerate(sorted({d for r in rows for d in r.s}))}

        def bits(sets) -> np.ndarray:
            out = np.zeros((-(-len(place) // 64) or 1, len(sets)), np.uint64)
            for j, s in enumerate(sets):
                for i in (place[d] for d in s if d in place):
                    out[i // 64, j] |= np.uint64(1 << i % 64)
            return out

        other, n = bits([r.s for r in rows]), np.array([r.n for r in rows], float)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                own, found = bits(pdf["s"]), []
                for lo in range(0, len(pdf), AT_ONCE):
                    met = np.zeros((len(pdf["s"].iloc[lo : lo + AT_ONCE]), len(n)), bool)
                    for a, b in zip(own, other, strict=True):
                        met |= (a[lo : lo + AT_ONCE, None] & b) != 0
                    found.append(met @ n)
                yield pd.DataFrame({"k": pdf["k"], "c": np.concatenate(found or [np.zeros(0)]).astype(np.int64)})

        return keyed.select("k", "s").mapInPandas(run, "k string, c long")

    # a set's name is its text, which is exact
    keyed = kinds.withColumn("k", F.col("s").cast("string")).repartition("k")
    some = [kinds.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == b) for b in range(blocks)]
    met = reduce(DataFrame.union, map(of, some)).groupBy("k").agg((F.sum("c") - 1).alias("peers"))
    met = cut(met, "met")
    met = F.broadcast(met) if blocks == 1 else met  # few kinds: many members of one aren't dealt to one task
    return held.select("m", F.col("s").cast("string").alias("k")).join(met, "k").where("peers > 0").select("m", "peers")


def gap_pairs(values: DataFrame, gap: int) -> DataFrame:
    """(d, pairs): pairs of a group of which one is better by more than ``gap``; ``values``: (d, w), whole numbers.

    Counted by a range over the sorted values, no pair is made. Null groups and values are in no pair.
    """
    below = F.count("*").over(Window.partitionBy("d").orderBy("w").rangeBetween(Window.unboundedPreceding, -gap - 1))
    known = values.where("d is not null and w is not null").withColumn("k", below)
    return known.groupBy("d").agg(F.sum("k").alias("pairs")).where("pairs > 0")


def rounded_mean(x: Column, times: int) -> Column:
    """The mean, times a whole number, rounded to a whole number, halves away from zero.

    Values of six decimals or fewer are summed as whole millionths: a sum of doubles depends on its order, and so would a
    half's side. Others, and sums beyond 64 bits, are rounded from the plain mean.
    """
    unit = F.when(F.abs(x) < 1e9, F.round(x * 1e6).cast("long"))
    total, n = F.try_sum(unit).cast("decimal(19,0)"), F.count(x).cast("decimal(12,0)")
    whole = (F.count_if(unit / 1e6 == x) == F.count(x)) & total.isNotNull()
    share = F.call_function("div", F.abs(total) * (2 * times) + n * 1_000_000, n * 2_000_000)
    return F.when(whole, F.signum(total).cast("long") * share).otherwise(F.round(F.avg(x) * times).cast("long"))


def sampling_mass(
    edges: DataFrame, models: DataFrame, n0: float = 1.0, alpha: float = 0.75, gamma: float = 0.0
) -> DataFrame:
    """(src, degree, q) of every model: mass by (degree + n0) ^ alpha, mixed with the uniform over models that have an edge.

    ``models``: (src); those without an edge carry mass too, but for the mixed part.
    """
    d = models.select("src").join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src", "left")
    d = d.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("m", F.pow(F.col("degree") + n0, F.lit(alpha)))
    t = d.agg(F.sum("m").alias("total"), F.count_if(F.col("degree") > 0).alias("labelled"))
    own = F.when(F.col("degree") > 0, 1 / F.col("labelled")).otherwise(F.lit(0.0))
    q = (1 - gamma) * F.col("m") / F.col("total") + gamma * own
    return d.crossJoin(F.broadcast(t)).select("src", "degree", q.alias("q"))  # one row


# fixed values: the marks at the end of a repository's name, in the order in which they are taken off
NAME_MARKS = (
    r"[-_.]?(q[2-8]_[0-9a-z_]+)$",
    r"[-_.]?(iq[0-9]+_[0-9a-z]+)$",
    r"[-_.]?(gguf|ggml|awq|gptq|exl2|mlx|bnb|nf4|fp16|fp8|bf16)$",
    r"[-_.]?(int4|int8|4bit|8bit|4-bit|8-bit)$",
    r"[-_.]?(q4|q5|q6|q8)$",
    r"[-_.]?(lora|qlora|adapter|peft)$",
)


def lineage_by_name(names: DataFrame) -> DataFrame:
    """(name, base) where taking off marks, all in turn and up to four times, gives another known name."""
    head, last = (F.regexp_extract("name", "^(.*/)?([^/]*)$", k) for k in (1, 2))

    def without(name: Column, mark: str) -> Column:
        """The name without the mark if three signs are left; a one-element array binds the name, so expressions don't multiply."""
        left = lambda x: F.regexp_replace(x, f"(?i){mark}", "")
        return F.get(F.transform(F.array(name), lambda x: F.when(F.length(left(x)) >= 3, left(x)).otherwise(x)), F.lit(0))

    for _ in range(4):
        for mark in NAME_MARKS:
            last = without(last, mark)
    last = names.select("name", head.alias("head"), last.alias("last"))
    found = last.select("name", F.concat("head", "last").alias("base")).where("name <> base")
    return found.join(names.select(F.col("name").alias("base")).distinct(), "base", "left_semi").select("name", "base")
