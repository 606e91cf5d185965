"""Lexical baselines: BM25 over exploded tokens, trigram overlap of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakewright.functions.text import trigrams, words
from lakewright.storage import cut


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): how often each word is in the text, counted inside the row, so no token is shuffled for it."""
    w = df.select(key, words(F.col(text)).alias("w"))
    each = w.select(key, F.explode(F.array_sort("w")).alias("token"))
    return each.groupBy(key, "token").agg(F.count("*").alias("tf"))


def bm25(
    queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, min_df: int = 2, max_df: float = 0.25
) -> DataFrame:
    """(query, doc, score) for documents that share a kept token with a query.

    ``queries``: (query, token); ``docs``: (doc, token, tf). Tokens in fewer than ``min_df`` or more than ``max_df`` of all
    documents are left out before anything is joined, so no list of a common word meets a join; a document's length counts
    kept tokens, and documents without any have length 0 in the mean. The counts are written once and read by all parts.
    """
    tf = cut(docs, "tf")
    n = tf.select("doc").distinct().count()
    df = tf.groupBy("token").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    kept = cut(tf.join(df.select("token", idf), "token"), "kept")
    size = kept.groupBy("doc").agg(F.sum("tf").alias("len"))
    mean = size.agg((F.sum("len") / F.lit(max(n, 1))).alias("avg_len"))
    hit = kept.join(queries.distinct(), "token").join(size, "doc").crossJoin(F.broadcast(mean))  # one row
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return hit.groupBy("query", "doc").agg(F.sum(part).alias("score"))


def trigram_similar(names: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of distinct names with a trigram Jaccard of ``least`` or more.

    A prefix filter: trigrams by how many names hold them, the rarest first; two names that are so similar share one of their
    first n - ceil(least n) + 1. So a common trigram joins only names that hold little else; the pairs found are then compared.
    """
    sets = names.select("name").distinct().withColumn("t", trigrams(F.col("name"))).withColumn("n", F.size("t"))
    each = sets.select("name", "n", F.explode("t").alias("g"))
    df = each.groupBy("g").agg(F.count("*").alias("f"))
    ordered = each.join(df, "g").groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("o"))
    first = F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    probe = ordered.select("name", "n", F.explode(first).alias("p")).where("p.f > 1").select("name", "n", "p.g")
    sized = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    left = probe.select(F.col("name").alias("a"), F.col("n").alias("na"), "g")
    right = probe.select(F.col("name").alias("b"), F.col("n").alias("nb"), "g")
    pairs = left.join(right, "g").where(F.col("a") < F.col("b")).where(sized).select("a", "b").distinct()
    x, y = (sets.select(F.col("name").alias(k), F.col("t").alias(f"t{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("jaccard"))
    return both.where(F.col("jaccard") >= least)


def jaccard(x: Column, y: Column) -> Column:
    """Shared share of two sets."""
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
