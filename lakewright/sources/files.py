"""Files as pinned data: inventories and their verification, atomic documents, graphs and pools as tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Write a JSON document so that readers meet the old one or the new one, never a part: a new file takes the name at once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    store = target.getFileSystem(conf)
    out = store.create(fresh, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode("utf-8")))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, target, options)


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of the files under a folder; the reader skips empty files, files above 2 GB raise."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(pinned: DataFrame, found: DataFrame) -> DataFrame:
    """(file, fault): files of either inventory that are missing, not pinned, or of another size or content."""
    p = pinned.select("file", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"), F.lit(True).alias("_p"))
    f = found.select("file", "bytes", "sha256", F.lit(True).alias("_f"))
    fault = F.when(F.col("_f").isNull(), "missing").when(F.col("_p").isNull(), "not pinned").when(~F.col("_b").eqNullSafe(F.col("bytes")), "size")
    fault = fault.when(~F.col("_s").eqNullSafe(F.col("sha256")), "content")
    return p.join(f, "file", "full").select("file", fault.alias("fault")).where("fault is not null")


def profile(manifest: DataFrame, name: str) -> DataFrame:
    """Rows of a manifest (file, profiles, ...) that belong to a profile; an unknown or empty one raises."""
    kept = manifest.where(F.array_contains("profiles", name))
    if not kept.take(1):
        raise ValueError(f"no file has the profile {name}")
    return kept


def save_graph(relations: dict[str, DataFrame], path: str) -> None:
    """Edge lists (src, dst, ...) as one Parquet table a relation."""
    for name, edges in relations.items():
        edges.write.mode("overwrite").parquet(f"{path}/relation={name}")


def read_edges(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """The edge list of a relation; raises if it has no src or dst."""
    edges = spark.read.parquet(f"{path}/relation={relation}")
    if not {"src", "dst"} <= set(edges.columns):
        raise ValueError(f"{relation} has no src or dst")
    return edges


def save_pools(pools: DataFrame, path: str) -> DataFrame:
    """Pools (query, items, scores) as a long table (query, rank from 1, item, score), written and read again.

    Lists of different lengths raise when the rows are written; null lists give no row.
    """
    same = F.assert_true(F.coalesce(F.size("items") == F.size("scores"), F.lit(True)), F.lit("items and scores differ in length"))
    zipped = pools.select("query", F.when(same.isNull(), F.arrays_zip("items", "scores")).alias("z"))
    long = zipped.select("query", F.posexplode("z").alias("pos", "e"))
    long.select("query", (F.col("pos") + 1).alias("rank"), F.col("e.items").alias("item"), F.col("e.scores").alias("score")).write.mode("overwrite").parquet(path)
    return pools.sparkSession.read.parquet(path)


def committed_lines(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """(file, line, value): of each shard the lines that its ledger (file, lines) counts; what a crash left behind them goes.

    Lines are numbered by the place of their block and their order inside it; a shard without a ledger row has none.
    """
    raw = spark.read.text(path).select(
        "value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i")
    )
    by: Column = F.row_number().over(Window.partitionBy("file").orderBy("_at", "_i"))
    return raw.withColumn("line", by).join(F.broadcast(ledger), "file").where("line <= lines").select("file", "line", "value")
