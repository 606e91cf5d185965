"""Metrics of returned lists: hits, gains, calibration, agreement, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.operators.ordering import running

#: How far below the best a label counts as near the best.
GAP = 0.01
#: Most queries of a paired bootstrap (8 bytes each in every task).
MOST_PAIRED = 4_000_000


def probes(labels: DataFrame, gap: float = GAP) -> DataFrame:
    """``labels`` (query, item, value) with gold, top3 and near flags; ties to the smaller item."""
    by = Window.partitionBy("query")
    r = F.row_number().over(by.orderBy(F.desc("value"), "item"))
    return labels.withColumn("_r", r).withColumn("gold", F.col("_r") == 1).withColumn("top3", F.col("_r") <= 3).withColumn("near", F.col("value") >= F.max("value").over(by) - gap).drop("_r")


def query_ranks(ranked: DataFrame) -> DataFrame:
    """Per query: ranks of gold, best of top 3, best near gold; from probes joined with their ranks."""
    return ranked.groupBy("query").agg(
        F.min(F.when(F.col("gold"), F.col("rank"))).alias("gold_rank"),
        F.min(F.when(F.col("top3"), F.col("rank"))).alias("top3_rank"),
        F.min(F.when(F.col("near"), F.col("rank"))).alias("gap_rank"),
        F.count("*").alias("n_candidates"),
    )


def hit(rank: Column, k: int) -> Column:
    """1 if the rank is k or better; a missing rank is a miss."""
    return F.coalesce((rank <= k).cast("double"), F.lit(0.0))


def macro(df: DataFrame, root: str, value: str) -> DataFrame:
    """(micro, macro): the mean over queries, and the mean over roots of their means."""
    by = df.groupBy(root).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return by.agg((F.sum("s") / F.sum("n")).alias("micro"), F.avg("m").alias("macro"))


def ndcg(scored: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg) with gains scaled to 0..1 by the query's labels; constant labels give 1."""
    by = Window.partitionBy("query")
    lo, hi = F.min("value").over(by), F.max("value").over(by)
    gain = F.coalesce((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0))
    r = F.row_number().over(by.orderBy(F.desc("score"), "item"))
    i = F.row_number().over(by.orderBy(F.desc("value"), "item"))
    d = scored.select("query", gain.alias("g"), r.alias("r"), i.alias("i"))
    dcg = lambda at: F.sum(F.when(F.col(at) <= k, F.col("g") / F.log2(F.col(at) + 1)).otherwise(0.0))
    return d.groupBy("query").agg((dcg("r") / dcg("i")).alias("ndcg"))


def kendall(scored: DataFrame, least: int = 2) -> DataFrame:
    """(query, tau): tie-corrected rank correlation of score and value, for queries with ``least`` candidates or more.

    Concordant pairs are counted by inversions inside one query's candidates (n log n), so no pair is made.
    """

    def tau(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1] for c in ("score", "value"))
        n = len(x)
        pairs = lambda codes: int((np.bincount(codes).astype(np.int64) * (np.bincount(codes) - 1) // 2).sum())
        total, tx, ty = n * (n - 1) // 2, pairs(x), pairs(y)
        both = pairs(np.unique(x.astype(np.int64) * (int(y.max()) + 1) + y, return_inverse=True)[1])
        tree, less = [0] * (int(y.max()) + 2), 0  # how many earlier candidates have each value or less
        order = np.lexsort((-y, x))  # equal scores are not counted: their values fall
        for v in y[order].tolist():
            k = v
            while k > 0:
                less += tree[k]
                k -= k & -k
            k = v + 1
            while k < len(tree):
                tree[k] += 1
                k += k & -k
        against = total - tx - ty + both - less
        root = np.sqrt(float(total - tx) * float(total - ty))
        return pd.DataFrame({"query": [key[0]], "tau": [(less - against) / root if root else None], "n": [n]})

    made = scored.select("query", "score", "value").groupBy("query").applyInPandas(tau, "query long, tau double, n long")
    return made.where(F.col("n") >= least).select("query", F.when(~F.isnan("tau"), F.col("tau")).alias("tau"))


def spearman(scored: DataFrame) -> DataFrame:
    """(query, rho): correlation of average ranks."""
    by = Window.partitionBy("query")

    def average_rank(c: str) -> Column:
        return F.rank().over(by.orderBy(c)) + (F.count("*").over(Window.partitionBy("query", c)) - 1) / 2.0

    d = scored.select("query", average_rank("score").alias("a"), average_rank("value").alias("b"))
    return d.groupBy("query").agg(F.try_divide(F.covar_pop("a", "b"), F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))).alias("rho"))


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y, gap_share): rows of the expected calibration error, whose sum of shares it is."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    g = pairs.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(total).withColumn("gap_share", F.abs(F.col("mean_p") - F.col("mean_y")) * F.col("n") / F.col("total")).drop("total")


def random_hits(n_pool: int, near: Column, k: int) -> Column:
    """Chance that k random items of a pool hold one of ``near``."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, j: p * F.greatest(F.lit(n_pool) - near - j, F.lit(0)) / (F.lit(n_pool) - j))
    return 1 - miss


def bootstrap(deltas: DataFrame, rounds: int = 10_000, block: int = 250) -> DataFrame:
    """(n_paired, mean_delta, ci_low, ci_high, prob_positive): paired bootstrap of (query, delta), n draws a round.

    Queries are numbered by id; draw j of round r takes the one at a hash of (r, j). Rounds are dealt to tasks in blocks and
    each task holds the deltas of one seed's queries, 8 bytes each. Without rows the bounds are null.
    """
    kept = deltas.where("delta is not null")
    if kept.count() > MOST_PAIRED:
        raise ValueError(f"more than {MOST_PAIRED} paired queries: each task would hold them all")
    numbered = running(kept, [F.col("query")])
    values = np.array([r.delta for r in numbered.select("row", "delta").orderBy("row").collect()])  # one number a query
    spark = deltas.sparkSession

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in pdf["id"]:
                salts = np.arange(first * block, min(rounds, (first + 1) * block), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                means = []
                for salt in salts:
                    h = np.arange(len(values), dtype=np.uint64) + salt
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    means.append(values[((h ^ (h >> np.uint64(32))) % np.uint64(max(len(values), 1))).astype(np.int64)].mean())
                yield pd.DataFrame({"m": means})

    made = spark.range(-(-rounds // block) if len(values) else 0).repartition(8).mapInPandas(draw, "m double")
    bounds = made.agg(
        F.percentile("m", F.lit(0.025)).alias("ci_low"),
        F.percentile("m", F.lit(0.975)).alias("ci_high"),
        F.avg((F.col("m") > 0).cast("int")).alias("prob_positive"),
    )
    mean = (len(values), float(values.mean()) if len(values) else None)
    return spark.createDataFrame([mean], "n_paired long, mean_delta double").crossJoin(bounds)  # one row each


def specificity(lists: DataFrame, n_items: int) -> DataFrame:
    """(catalog_coverage, unique_share, mean_jaccard) of lists (query, signature, item): the mean over pairs of equal signature."""
    per = lists.groupBy("query", "signature").agg(F.array_sort(F.collect_set("item")).alias("items"))
    pairs = per.select("signature", F.col("query").alias("a"), F.col("items").alias("x")).join(per.select("signature", F.col("query").alias("b"), F.col("items").alias("y")), "signature").where("a < b")
    j = pairs.agg(F.avg(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("mean_jaccard"))
    u = per.agg((F.countDistinct("items") / F.count("*")).alias("unique_share"))
    return lists.agg((F.countDistinct("item") / F.lit(n_items)).alias("catalog_coverage")).join(u).join(j)
