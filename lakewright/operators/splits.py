"""Splits, supervision, negatives and budgets of an evidence graph: by hashes, so they agree on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.operators import retrieval
from lakewright.operators.ordering import running


def draw(seed: int, *keys: str) -> Column:
    """A number from 0 to 1 by a hash of the keys: the first 52 bits of an MD5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def root_aware(edges: DataFrame, sides: DataFrame, seed: int, disjoint: float = 0.3) -> DataFrame:
    """Edges (src, dst, root, ...) with their root's side and role: message edges, or label edges that are only predicted.

    Of the training side a hashed share ``disjoint`` are labels, so no edge is both; held-out sides are labels alone.
    """
    e = edges.join(sides.select("root", "side"), "root")
    label = (F.col("side") != "train") | (draw(seed, "src", "dst") < disjoint)
    return e.withColumn("role", F.when(label, "label").otherwise("message"))


def link_split(edges: DataFrame, seed: int, val: float = 0.1, test: float = 0.2, disjoint: float = 0.3) -> DataFrame:
    """Edges with side test, val, train (messages) or disjoint (training labels), by ranks of a hashed order."""
    n = edges.count()
    n_test, n_val = round(test * n), round(val * n)
    n_labels = round(disjoint * (n - n_test - n_val))
    r = running(edges.withColumn("_o", draw(seed, "src", "dst")), [F.col("_o"), F.col("src"), F.col("dst")], number="_r")
    side = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val")
    side = side.when(F.col("_r") <= n_test + n_val + n_labels, "disjoint").otherwise("train")
    return r.withColumn("side", side).drop("_o", "_r")


def pair_index(src: Column, dst: Column, n_dst: Column) -> Column:
    """The pair's place in the row-wise matrix of all pairs; ``// n`` and ``% n`` give it back."""
    return src * n_dst + dst


def negatives(positives: DataFrame, edges: DataFrame, models: DataFrame, datasets: DataFrame, seed: int, tries: int = 20) -> DataFrame:
    """(src, dst): for each positive one pair that is no edge, drawn uniformly from models and datasets by hashes.

    Each positive makes ``tries`` draws and keeps its first that is no edge; one whose draws are all edges keeps none.
    ``models`` and ``datasets``: (id), numbered densely here.
    """
    m = running(models.select(F.col("id").alias("src")), [F.col("src")], number="mi")
    d = running(datasets.select(F.col("id").alias("dst")), [F.col("dst")], number="di")
    nm, nd = m.count(), d.count()
    key = F.concat_ws(":", "src", "dst")
    p = positives.select(key.alias("p")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    p = p.withColumn("mi", (F.floor(draw(seed, "p", "t") * nm) + 1)).withColumn("di", F.floor(draw(seed + 1, "p", "t") * nd) + 1)
    pairs = p.join(m, "mi").join(d, "di").join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    one = pairs.groupBy("p").agg(F.min_by(F.struct("src", "dst"), F.col("t")).alias("e"))
    return one.select("p", "e.src", "e.dst")


def dropout(edges: DataFrame, rates: dict[str, float], seed: int) -> DataFrame:
    """Edges (relation, src, dst) that survive their relation's rate; relations without a rate stay whole."""
    rate = F.lit(0.0)
    for name, p in rates.items():
        rate = F.when(F.col("relation") == name, F.lit(p)).otherwise(rate)
    return edges.where(draw(seed, "relation", "src", "dst") >= rate)


def budget(nodes: DataFrame, limit: int) -> DataFrame:
    """(old_id, id): critical nodes first, then those of the highest degree, ``limit`` at most; ids dense from 0 in order of old_id.

    ``nodes``: (old_id, critical, degree); nodes without an edge are left out. All critical ones stay even beyond the limit.
    """
    order = [F.col("critical").desc(), F.desc("degree"), F.col("old_id")]
    r = running(nodes.where("degree > 0"), order, number="_r").where((F.col("_r") <= limit) | F.col("critical"))
    return running(r.select("old_id"), [F.col("old_id")], number="id").withColumn("id", F.col("id") - 1)


def subgraph(edges: DataFrame, models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Edges between kept nodes, by their new ids."""
    m = models.select(F.col("old_id").alias("src"), F.col("id").alias("s"))
    d = datasets.select(F.col("old_id").alias("dst"), F.col("id").alias("d"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(m, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *rest)


def hard_negatives(scored: DataFrame, positives: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """(query, item, rank): the k best-scored items that are no positives, nor related to one (an alibi).

    ``scored``: a pool (query, item, score); ``positives``: (query, item); ``roots``: (item, root), whose members are alibis of each other.
    """
    alibi = positives.join(roots, "item").select("query", "root").distinct()
    left = scored.join(positives.select("query", "item"), ["query", "item"], "left_anti").join(roots, "item", "left")
    left = left.join(alibi, ["query", "root"], "left_anti")
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return left.withColumn("rank", r).where(F.col("rank") <= k).select("query", "item", "rank")


def searched_negatives(queries: DataFrame, items: DataFrame, alibi: DataFrame, k: int) -> DataFrame:
    """``hard_negatives`` of whole queries (query, q) and items (item, v, root) by one search, without a pool of all pairs.

    ``alibi``: (query, root) of the positives, which are so left out with all that is related to them.
    """
    barred = alibi.select("query", F.col("root").alias("group")).distinct()
    found = retrieval.blocked_top_k(queries, items.withColumnRenamed("root", "group"), k, skip_self=True, barred=barred)
    return found.select("query", "item", "rank")


def density(edges: DataFrame, least: float) -> DataFrame:
    """(n_pairs, n_edges, positive_share, density): share of edges with weight ``least`` or more; edges over all pairs."""
    one = edges.agg(
        F.countDistinct("src").alias("m"), F.countDistinct("dst").alias("d"), F.count("*").alias("n_edges"),
        F.avg((F.col("w") >= least).cast("double")).alias("positive_share"),
    )
    pairs = F.col("m") * F.col("d")
    return one.select(pairs.alias("n_pairs"), "n_edges", "positive_share", (F.col("n_edges") / pairs).alias("density"))


def feasible(sizes: DataFrame, sides: DataFrame, least: int) -> DataFrame:
    """(side, roots, edges, ok): a split is feasible if each side has ``least`` roots and an edge."""
    g = sizes.join(sides.select("root", "side"), "root").groupBy("side").agg(F.count("*").alias("roots"), F.sum("n").alias("edges"))
    return g.withColumn("ok", (F.col("roots") >= least) & (F.col("edges") > 0))
