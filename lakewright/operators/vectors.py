"""Geometry of vector tables: covariance, principal axes, interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products) of (v): each task sends one matrix of dims x dims."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), np.float64)
                s = x.sum(0) if s is None else s + x.sum(0)
                ss = x.T @ x if ss is None else ss + x.T @ x
                n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    made = vectors.select("v").mapInPandas(run, "n long, s array<double>, ss array<double>")
    whole = made.agg(F.sum("n").alias("n")).first().n or 0
    if not whole:
        return 0, np.zeros(0), np.zeros((0, 0))
    sums = {}
    for c in ("s", "ss"):  # dims and dims^2 numbers
        rows = made.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        sums[c] = np.array([r.x for r in rows])
    return int(whole), sums["s"], sums["ss"].reshape(len(sums["s"]), -1)


def participation(vectors: DataFrame) -> DataFrame:
    """(participation_ratio): trace(C)^2 / trace(C^2) of the covariance; null without rows or spread."""
    n, s, ss = moments(vectors)
    c = ss / n - np.outer(s / n, s / n) if n else np.zeros((1, 1))
    square = float((c * c).sum())
    ratio = float(np.trace(c) ** 2 / square) if square > 0 else None
    return vectors.sparkSession.createDataFrame([(ratio,)], "participation_ratio double")


def principal(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes k x dims, variances): principal axes, the largest first, each with its largest component positive."""
    n, s, ss = moments(vectors)
    mean = s / max(n, 1)
    values, axes = np.linalg.eigh(ss / max(n, 1) - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    axes = axes[:, order].T
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return mean, axes * sign[:, None], values[order]


def project(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(item, p array<double>): coordinates on the axes, as expressions on the row."""
    centred = F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda x, m: x.cast("double") - m)

    def on(axis: list[float]):
        return F.aggregate(F.zip_with(centred, F.array(*map(F.lit, axis)), lambda x, a: x * a), F.lit(0.0), lambda t, x: t + x)

    return vectors.select("item", F.array(*[on(a.tolist()) for a in axes]).alias("p"))


def interpolate(near: DataFrame, places: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(query, pos, value): means of the neighbours' places weighted by inverse distance (1 - score)."""
    w = 1 / (F.greatest(1 - F.col("score"), F.lit(0.0)) + eps)
    each = near.withColumn("w", w).join(places.select("item", F.posexplode("p").alias("pos", "x")), "item")
    return each.groupBy("query", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("value"))


def mean_of_tokens(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(key, pos, value): mean of the vectors of a key's tokens; tokens without a vector don't count."""
    at = vectors.select("token", F.posexplode("v").alias("pos", "x"))
    return tokens.join(at, "token").groupBy("key", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def mask_violations(vectors: DataFrame, positions: tuple[int, ...]) -> DataFrame:
    """(pos, n): how many vectors are not 0 at each position that should be masked."""
    each = vectors.select(F.explode(F.array(*map(F.lit, positions))).alias("pos"), "v")
    return each.groupBy("pos").agg(F.count_if(F.coalesce(F.get("v", F.col("pos")), F.lit(1.0)) != 0).alias("n"))


def align(a: DataFrame, b: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """(rotation, determinant, mean shift before, after) that turns places ``b`` onto ``a``, both (item, p) with few dimensions.

    The orthogonal matrix, a mirror allowed, of least squares over the common items, without scaling; what reaches the driver
    is one matrix of dims x dims sums. Different items on the two sides raise.
    """
    both = a.select("item", F.col("p").alias("x")).join(b.select("item", F.col("p").alias("y")), "item", "full")
    head = both.where("x is not null").select(F.size("x").alias("d")).first()
    if head is None or both.where("x is null or y is null").take(1):
        raise ValueError("the two layouts don't hold the same items")
    d = head.d
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    means = both.agg(*[F.avg(at(c, i)).alias(f"{c}{i}") for c in "xy" for i in range(d)]).first()
    sums = both.agg(*[F.sum((at("y", i) - means[f"y{i}"]) * (at("x", j) - means[f"x{j}"])).alias(f"s{i}_{j}") for i in range(d) for j in range(d)]).first()
    u, _, vt = np.linalg.svd(np.array([[sums[f"s{i}_{j}"] for j in range(d)] for i in range(d)]))
    r = u @ vt
    turned = [sum((at("y", i) * float(r[i, j]) for i in range(d)), F.lit(0.0)) for j in range(d)]
    length = lambda parts: F.sqrt(sum((F.pow(p - at("x", j), 2) for j, p in enumerate(parts)), F.lit(0.0)))
    shift = both.agg(F.avg(length([at("y", j) for j in range(d)])).alias("raw"), F.avg(length(turned)).alias("fit")).first()
    return r, float(np.linalg.det(r)), shift.raw, shift.fit


def quantise(places: DataFrame, share: float = 0.999) -> DataFrame:
    """(item, q array<int>): coordinates as whole numbers up to 32,767 on one scale, 1.02 times the share-quantile of their sizes.

    Halves go to even; what lies beyond the scale is cut to its end. Places that are all 0 stay 0.
    """
    each = places.select(F.explode("p").alias("x")).agg((F.percentile(F.abs("x"), F.lit(share)) * 1.02).alias("scale"))
    one = lambda x: F.greatest(F.lit(-32767), F.least(F.lit(32767), F.bround(F.coalesce(x / F.nullif("scale", F.lit(0.0)), F.lit(0.0)) * 32000.0, 0).cast("int")))
    return places.crossJoin(F.broadcast(each)).select("item", F.transform("p", one).alias("q"))  # one row


def slots(families: DataFrame, most: int = 26, least: int = 400) -> DataFrame:
    """(family, n, slot): the largest families with ``least`` items or more, 0 (other) apart, numbered from 1; ties to the smaller id."""
    n = families.where("family <> 0").groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = n.orderBy(F.desc("n"), "family").limit(most)  # at most ``most`` rows
    return top.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("n"), "family")))
