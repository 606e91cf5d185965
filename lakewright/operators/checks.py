"""Constraints as queries: violations, table equality, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule, all rules in one pass; null counts as broken."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])
    return one.select(F.inline(pairs))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n): how many keys have more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of the left side that the right side lacks."""
    return left.select(*on).join(right.select(*on), on, "left_anti")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): rows, with repeats, on one side alone."""
    x = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    return x.join(b.exceptAll(a).agg(F.count("*").alias("only_right")))


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): an order-independent checksum of the rows' MD5 halves."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns]))
    half = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(half).cast("string").alias("digest"))


def report(*parts: DataFrame) -> DataFrame:
    """Reports with equal columns, one under the other."""
    return reduce(DataFrame.unionByName, parts)
