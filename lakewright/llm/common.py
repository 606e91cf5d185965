"""What the corpus operators share: word counts, row-key columns and clash-free column handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A word: a run of characters other than the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text counts 0.

    The pieces between single blanks, but for the empty ones: one pass, where replacing runs of blanks takes three times as long.
    """
    pieces = F.array_remove(F.split(text, r"[\x20\x09-\x0D]"), "")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(pieces)).cast("long")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns, whatever their names, don't reach the operator."""
    return df.select(*(df[n] for n in names))
