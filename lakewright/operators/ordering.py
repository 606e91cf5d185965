"""Global numbering and running sums without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.storage import cut, shuffle_width


def running(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None, number: str = "row") -> DataFrame:
    """``df`` with ``number`` (from 1) in the global ``order`` and, for each (name, column) of ``sums``, the sum before the row.

    Rows are dealt to ranges of the order, which are written once; each range is numbered by itself and starts where the
    ranges before it end. Only one row a range meets in one task. ``order`` should tell all rows apart.
    """
    sums = sums or {}
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_at"),
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_s_{k}") for k in sums],
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_range").withColumn(number, F.row_number().over(inside) + F.col("_at"))
    for k, c in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"_s_{k}"))
    return out.drop("_range", "_at", *[f"_s_{k}" for k in sums])
