"""Exact vector retrieval, fusion with priors, reranking and ranks.

A stated query set meets all items in blocks: QUERIES queries at a time go to the tasks by value (their number bounds their size),
each task keeps what it needs of its items, and what is shuffled is a few rows for each query and task. Scores are rounded
to DIGITS decimals, so that equal vectors tie however their products were summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.functions.text import tie_key
from lakewright.functions.vector import dot
from lakewright.operators.ordering import running
from lakewright.storage import cut

#: Queries a block, queries and items multiplied at once, decimals of a score.
QUERIES, PART, DIGITS = 8192, 512, 9
#: Stands for a null item: it comes last among ties.
NO_ITEM = 2**63 - 1


def _blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """The queries in parts of about QUERIES by a hash of their id."""
    n = max(1, -(-queries.count() // QUERIES))
    for b in range(n):
        yield queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == b)


def scores(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query, item, score) of every pair of a stated query set and the items: the native path, a broadcast a block."""
    parts = [F.broadcast(b.select("query", "q")).join(items.select("item", "v")) for b in _blocks(queries)]
    score = F.round(dot(F.col("q"), F.col("v")), DIGITS).alias("score")
    return reduce(DataFrame.union, parts).select("query", "item", score)


def pair_scores(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs`` (query, item, ...) with their score: both vectors are joined by key, no other pair is made."""
    told = pairs.join(queries.select("query", "q"), "query").join(items.select("item", "v"), "item")
    return told.withColumn("score", F.round(dot(F.col("q"), F.col("v")), DIGITS)).select(*pairs.columns, "score")


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The first k rows of each group, with rank; by default by score, ties to the smaller item."""
    by, order = by or ["query"], order or [F.desc("score"), F.col("item").asc()]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _order(score: np.ndarray) -> np.ndarray:
    """Whole numbers in the order in which the engine sorts doubles: NaN above infinity, -0.0 as 0.0."""
    s = np.where(np.isnan(score), np.nan, score + 0.0)
    bits = np.ascontiguousarray(s, float).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _whole(v: str) -> Column:
    """The vector, or null if a component is null."""
    return F.when(F.forall(v, lambda x: x.isNotNull()), F.col(v)).alias(v)


def _array(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, and which are null (zeros stand for them)."""
    null = np.array([v is None for v in vectors], bool)
    width = next((len(v) for v in vectors if v is not None), 0)
    none = np.zeros(width)
    return np.array([none if v is None else v for v in vectors], float).reshape(len(vectors), width), null


def blocked_top_k(
    queries: DataFrame, items: DataFrame, k: int, skip_self: bool = False, digits: int | None = None, barred: DataFrame | None = None
) -> DataFrame:
    """The same as ``top_k(scores(...))``, by matrix products: one pass over the items a block of queries.

    A task keeps the k best of its items for each query of the block, so its memory doesn't grow with the items. With
    ``digits`` lists are ordered by the score rounded to as many, halves away from zero; items with a column ``less`` score 2 score - less;
    ``barred``: (query, group), the groups of items (a column ``group``) that a query skips. Null vectors score null, which comes last.
    """
    slack = 0.0 if digits is None else 0.51 * 10.0**-digits
    extra = [c for c in ("less", "group") if c in items.columns]

    def ordered(s: np.ndarray) -> np.ndarray:
        if digits is None:
            return s
        up = np.abs(s) * 10.0**digits
        up = np.where(up - np.floor(up) >= 0.5, np.floor(up) + 1, np.floor(up))
        return np.copysign(up / 10.0**digits, s)

    def of(block: DataFrame) -> DataFrame:
        rows = block.select("query", _whole("q")).collect()  # QUERIES rows about
        ids = np.array([r["query"] for r in rows], np.int64)
        q, no_query = _array([r["q"] for r in rows])
        closed: dict[int, set] = {}
        barring = barred is not None
        if barring:
            for r in barred.join(F.broadcast(block.select("query").distinct()), "query", "left_semi").collect():
                closed.setdefault(r["query"], set()).add(r["group"])
        shut = [np.array(sorted(closed.get(int(i), ())), np.int64) for i in ids]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # of each query: order (null least), item, score
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
            least = np.full(len(ids), -np.inf)  # below which a score can't enter a list
            for pdf in batches:
                x, no_item = _array(list(pdf["v"]))
                at, some_null = pdf["item"].to_numpy(), no_item.any()
                group = pdf["group"].to_numpy() if barring else None
                for lo in range(0, len(ids) if len(at) else 0, PART):
                    left = q[lo : lo + PART]
                    with np.errstate(all="ignore"):
                        known = not (no_item.all() or no_query.all())
                        s = np.round(left @ x.T, DIGITS) if known else np.zeros((len(left), len(at)))
                        if "less" in extra:
                            s = 2 * s - pdf["less"].to_numpy()
                    near = ~(s < least[lo : lo + PART, None])  # NaN too
                    if some_null:
                        near[:, no_item] |= np.isneginf(least[lo : lo + PART, None])
                    for i in np.flatnonzero(near.any(1)):
                        j = lo + i
                        some = np.flatnonzero(near[i])
                        if skip_self:
                            some = some[at[some] != ids[j]]
                        if len(shut[j]):
                            some = some[~np.isin(group[some], shut[j])]
                        score = ordered(s[i, some])
                        rank = np.where(no_item[some] | no_query[j], np.iinfo(np.int64).min, _order(score))
                        order, held, value = best[j]
                        order, held = np.concatenate([order, rank]), np.concatenate([held, at[some]])
                        value = np.concatenate([value, s[i, some]])
                        keep = np.lexsort((held, ~order))[:k]
                        best[j] = order[keep], held[keep], value[keep]
                        if len(keep) == k and order[keep[-1]] > np.iinfo(np.int64).min:
                            # a NaN, above all numbers, bars none of them here: the order decides
                            last = ordered(value[keep[-1:]])[0]
                            least[j] = -np.inf if np.isnan(last) else last - slack
            for qid, (order, i, v) in zip(ids, best, strict=True):
                if len(i):
                    # pandas would make nulls of NaN: both are told apart by name
                    gone = order == np.iinfo(np.int64).min
                    yield pd.DataFrame({"query": qid, "item": i, "score": v, "by": order, "gone": gone, "nan": np.isnan(v)})

        made = items.select(F.coalesce("item", F.lit(NO_ITEM)).alias("item"), _whole("v"), *extra)
        return made.mapInPandas(run, "query long, item long, score double, by long, gone boolean, nan boolean")

    every = reduce(DataFrame.union, [of(b) for b in _blocks(queries)])
    first = top_k(every, k, order=[F.col("by").desc(), F.col("item").asc()])
    score = F.when(~F.col("gone"), F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("score"))).alias("score")
    return first.select("query", F.nullif("item", F.lit(NO_ITEM)).alias("item"), score, "rank")


def item_means(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item, less): the mean of each item's k best scores over the queries; null where no score is known.

    One pass over the items a block of queries; a task sends k scores an item.
    """

    def of(block: DataFrame) -> DataFrame:
        q, gone = _array([r["q"] for r in block.select(_whole("q")).collect()])  # QUERIES rows about
        q = q[~gone]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x, null = _array(list(pdf["v"]))
                x, at = x[~null], pdf["item"].to_numpy()[~null]
                for lo in range(0, len(at) if len(q) else 0, PART):
                    with np.errstate(all="ignore"):
                        s = np.round(x[lo : lo + PART] @ q.T, DIGITS)
                    most = min(k, s.shape[1])
                    s = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most :]
                    yield pd.DataFrame({"item": np.repeat(at[lo : lo + PART], most), "score": s.ravel(), "nan": np.isnan(s.ravel())})

        return items.where("item is not null").select("item", _whole("v")).mapInPandas(run, "item long, score double, nan boolean")

    every = reduce(DataFrame.union, [of(b) for b in _blocks(queries)])
    every = every.withColumn("score", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("score")))
    best = top_k(every, k, by=["item"], order=[F.desc("score")])
    return items.select("item").distinct().join(best.groupBy("item").agg(F.avg("score").alias("less")), "item", "left")


def blocked_csls(queries: DataFrame, items: DataFrame, near: int, k: int) -> DataFrame:
    """The first k by ``csls``, rounded to DIGITS decimals, ties to the smaller item: no score is kept beyond the lists."""
    less = cut(item_means(queries, items, near), "less")
    known = items.where("item is not null").join(less, "item")
    return blocked_top_k(queries, known.withColumn("v", F.when(F.col("less").isNotNull(), F.col("v"))), k, digits=DIGITS)


def tie_keys(ids: np.ndarray) -> np.ndarray:
    """The fixed permutation of ids of ``tie_key``, wrapped modulo 2^64."""
    return ids.astype(np.uint64) * np.uint64(11400714819323198485) + np.uint64(15111065706836454659)


def fuse_score(score: Column, prior: Column) -> Column:
    """(score + 1) / 2 + prior in single precision."""
    one, two = F.lit(1).cast("float"), F.lit(2).cast("float")
    return ((score.cast("float") + one) / two).cast("float") + F.coalesce(prior, F.lit(0.0)).cast("float")


def fuse(pool: DataFrame, prior: DataFrame, on: list[str], k: int = 10) -> DataFrame:
    """The pool reranked by ``fuse_score``, first k; ties by the fixed permutation of ids. Pairs without a prior have 0."""
    fused = pool.join(prior.select(*on, "prior"), on, "left").withColumn("fused", fuse_score(F.col("score"), F.col("prior")))
    return top_k(fused.drop("rank"), k, order=[F.desc("fused"), tie_key(F.col("item"))])


def gold_in_pool(reranked: DataFrame, pool_size: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, in_pool, gold_rank): a gold item that the pool misses has the rank after the pool's last.

    ``reranked``: the whole pool with rank; ``pool_size``: (query, k); ``gold``: (query, item).
    """
    found = gold.join(pool_size, "query").join(reranked.select("query", "item", "rank"), ["query", "item"], "left")
    rank = F.coalesce(F.col("rank"), F.col("k") + 1).cast("long").alias("gold_rank")
    return found.select("query", F.col("rank").isNotNull().alias("in_pool"), rank)


def backfill(prior_lists: DataFrame, universe: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Lists of prior-ranked items filled up to k with items of zero prior in the order of the tie permutation.

    ``prior_lists``: each query's k best at most. Of the universe only the first 2 k items can be needed, so a small head is joined.
    """
    head = universe.orderBy(tie_key(F.col("item")), "item").limit(2 * k).select("item")
    zero = queries.select("query").crossJoin(F.broadcast(head)).join(prior_lists.select("query", "item"), ["query", "item"], "left_anti")
    both = prior_lists.select("query", "item", "prior").unionByName(zero.withColumn("prior", F.lit(0.0)))
    return top_k(both, k, order=[F.desc("prior"), tie_key(F.col("item"))])


def full_ranks(
    queries: DataFrame, items: DataFrame, probes: DataFrame, prior: DataFrame | None = None, tie_break: bool = False
) -> DataFrame:
    """(query, item, rank) of probe items among all items: 1 + those above, ties optimistic or by the permutation.

    With ``prior`` (task, item, prior) and a task for each query also fused_rank and prior_rank: the ranks by ``fuse_score``
    and by the prior alone. Probes are scored by key first; then one pass over the items a block of queries counts.
    """
    at = pair_scores(probes.select("query", "item"), queries, items)
    held, fusing = items.select("item", "v"), prior is not None
    if prior is not None:
        at = at.join(queries.select("query", "task"), "query").join(prior, ["task", "item"], "left")
        maps = prior.groupBy("item").agg(F.collect_list(F.struct("task", "prior")).alias("p"))  # one entry a task
        held = held.join(maps, "item", "left")
    at = cut(at.withColumn("prior", F.coalesce("prior", F.lit(0.0)) if prior is not None else F.lit(0.0)), "probes")
    kinds = ("rank",) if prior is None else ("rank", "fused_rank", "prior_rank")

    def of(block: DataFrame) -> DataFrame:
        rows = block.select("query", "q", *(["task"] if fusing else [])).collect()  # QUERIES rows about
        spots = at.join(F.broadcast(block.select("query")), "query", "left_semi").collect()  # a few probes each
        place = {r["query"]: i for i, r in enumerate(rows)}
        q = np.array([r.q for r in rows], float)
        tasks = np.array([r.task for r in rows]) if fusing else None
        by: list[list] = [[] for _ in rows]
        for r in spots:
            by[place[r["query"]]].append(r)

        def single(s: np.ndarray, p: np.ndarray) -> np.ndarray:
            return (s.astype(np.float32) + np.float32(1)) / np.float32(2) + p.astype(np.float32)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            above = [np.zeros((len(p), 3), np.int64) for p in by]
            for pdf in batches:
                x, ids = np.array(pdf["v"].tolist(), float), pdf["item"].to_numpy()
                tie = tie_keys(ids)
                mine: dict = {}
                if fusing:
                    for t in set(tasks.tolist()):
                        mine[t] = np.zeros(len(ids))
                    for j, entries in enumerate(pdf["p"]):
                        for e in entries if entries is not None else ():
                            if e["task"] in mine:
                                mine[e["task"]][j] = e["prior"]
                for lo in range(0, len(rows) if len(ids) else 0, PART):
                    s = np.round(q[lo : lo + PART] @ x.T, DIGITS)
                    for i, row in enumerate(s, lo):
                        p = mine[tasks[i]] if fusing else None
                        both = single(row, p) if fusing else None
                        for n, r in enumerate(by[i]):
                            pairs = [(row, r.score)]
                            if fusing:
                                own = single(np.array([r.score]), np.array([r.prior]))[0]
                                pairs += [(both, own), (p, r.prior)]
                            for kind, (all_, one) in enumerate(pairs):
                                above[i][n, kind] += np.count_nonzero(all_ > one)
                                if tie_break or kind:
                                    above[i][n, kind] += np.count_nonzero((all_ == one) & (tie < tie_keys(np.array([r.item]))[0]))
            out = [(r["query"], r["item"], *above[i][n].tolist()) for i, p in enumerate(by) for n, r in enumerate(p)]
            yield pd.DataFrame(out, columns=["query", "item", "a", "b", "c"])

        return held.mapInPandas(run, "query long, item long, a long, b long, c long")

    counted = reduce(DataFrame.union, [of(b) for b in _blocks(queries)])
    total = counted.groupBy("query", "item").agg(*[(F.sum(c) + 1).alias(k) for c, k in zip("abc", kinds, strict=False)])
    return total.select("query", "item", *kinds)


def csls(scored: DataFrame, k: int = 10) -> DataFrame:
    """Scores corrected for hubs: 2 score - the item's mean over its k best queries."""
    near = top_k(scored.select("query", "item", "score"), k, by=["item"], order=[F.desc("score"), F.col("query").asc()])
    r = near.groupBy("item").agg(F.avg("score").alias("r"))
    return scored.join(r, "item").withColumn("score", 2 * F.col("score") - F.col("r")).drop("r")


def static_ranks(values: DataFrame, score: str) -> DataFrame:
    """(item, rank, ties): one global order by score, ties by the permutation, made once and looked up by every query."""
    ordered = running(values, [F.col(score).desc(), tie_key(F.col("item"))], number="rank")
    ties = values.groupBy(score).agg((F.count("*") - 1).alias("ties"))
    return ordered.join(ties, score).select("item", F.col("rank").cast("long").alias("rank"), "ties")


def fusion_sweep(pool: DataFrame, prior: DataFrame, gold: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(beta, gold_10): share of queries whose gold is among the ten first by min-max score + beta x prior, for each weight.

    ``pool`` and ``prior`` by (query, item); ``gold``: (query, item); a gold item that the pool misses is a miss.
    """
    span = pool.groupBy("query").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    unit = F.coalesce((F.col("score") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.5))
    rows = pool.select("query", "item", "score").join(span, "query").join(prior, ["query", "item"], "left")
    rows = rows.select("query", "item", unit.alias("s"), F.coalesce("prior", F.lit(0.0)).alias("p"))
    every = rows.withColumn("beta", F.explode(F.array(*map(F.lit, weights))))
    mixed = every.withColumn("fused", F.round(F.col("s") + F.col("beta") * F.col("p"), DIGITS))
    first = top_k(mixed, 10, by=["beta", "query"], order=[F.desc("fused"), tie_key(F.col("item"))])
    hits = first.join(gold, ["query", "item"]).groupBy("beta").agg(F.count("*").alias("hits"))
    n = gold.agg(F.count("*").alias("n"))
    betas = gold.sparkSession.createDataFrame([(float(w),) for w in weights], "beta double")
    share = (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("gold_10")
    return betas.join(hits, "beta", "left").crossJoin(F.broadcast(n)).select("beta", share)
