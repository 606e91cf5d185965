"""Shrunken priors, leave-one-out totals and leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakewright.operators.ordering import running

#: Pseudo-observations of the shrinkage and the value they have.
SHRINK, CENTRE = 5, 0.5


def shrunken(total: Column, n: Column, k: int = SHRINK) -> Column:
    """(total + centre k) / (n + k)."""
    return (total + F.lit(CENTRE * k)) / (n + F.lit(k))


def priors(edges: DataFrame, grains: list[list[str]], k: int = SHRINK) -> DataFrame:
    """Shrunken means at each grain, in one pass over the edges by grouping sets."""
    keys = list(dict.fromkeys(c for g in grains for c in g))
    sets = [[F.col(c) for c in g] for g in grains]
    made = edges.groupingSets(sets, *map(F.col, keys)).agg(F.sum("weight").alias("total"), F.count("*").alias("n"), F.grouping_id().alias("grain"))
    return made.withColumn("prior", shrunken(F.col("total"), F.col("n"), k))


def leave_one_out(edges: DataFrame, key: list[str], own: list[str], k: int = SHRINK) -> DataFrame:
    """For each (key, own): the key's prior without what own contributes."""
    part = edges.groupBy(*dict.fromkeys([*key, *own])).agg(F.sum("weight").alias("own_total"), F.count("*").alias("own_n"))
    whole = part.groupBy(*key).agg(F.sum("own_total").alias("total"), F.sum("own_n").alias("n"))
    out = part.join(whole, key)
    return out.withColumn("prior", shrunken(F.col("total") - F.col("own_total"), F.col("n") - F.col("own_n"), k)).withColumn("others", F.col("n") - F.col("own_n"))


def split_roots(sizes: DataFrame, seed: int, test: float = 0.2, val: float = 0.1) -> DataFrame:
    """(root, n, side): roots in a seeded hash order fill the test side, then validation, then training.

    A root goes to test while those before it hold less than ``test`` of the edges; of the rest to validation likewise.
    ``sizes``: one row a root. Running sums go by ranges of the order, so no task meets all roots.
    """
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("root").cast("string"))), F.col("root")]
    total = sizes.agg(F.sum("n")).first()[0] or 0
    one = running(sizes, order, {"before": "n"})
    # the test side is a prefix of the order, so what lies before a later root is the test side and the rest before it
    tests = one.where(F.col("before") < test * total).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("held"))
    side = F.when(F.col("before") < test * total, "test").when(F.col("before") - F.col("held") < val * total, "val")
    return one.crossJoin(F.broadcast(tests)).select("root", "n", side.otherwise("train").alias("side"))
