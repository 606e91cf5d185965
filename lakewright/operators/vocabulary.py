"""Vocabularies with stable ids, and categories by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakewright.operators.ordering import running


def vocabulary(tokens: DataFrame, old: DataFrame, least: int) -> DataFrame:
    """(token, id): the ids of ``old`` stay, tokens seen ``least`` times get the next ones in their order."""
    seen = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    new = running(seen.join(old, "token", "left_anti").select("token"), [F.col("token")], number="r")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return old.select("token", "id").unionByName(new.crossJoin(F.broadcast(top)).select("token", (F.col("top") + F.col("r")).alias("id")))


def category_ids(df: DataFrame, column: str, words: DataFrame, out: str) -> DataFrame:
    """``df`` with the id of its category; 0 stands for other."""
    ids = words.select(F.col("token").alias(column), F.col("id").alias(out))
    return df.join(ids, column, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def inverted(codes: DataFrame) -> DataFrame:
    """(label, code) from (code, label); fails if a label has two codes."""
    if codes.groupBy("label").agg(F.count("*").alias("k")).where("k > 1").take(1):
        raise ValueError("a label has two codes")
    return codes.select("label", "code")
