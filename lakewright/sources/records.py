"""Nested model records: JSON lines in, claims and canonical columns out; sinks with manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakewright.functions.text import normal_id, number

#: What is read of a record; fields of changing shape stay JSON text.
RECORD = """id string, author string, downloads bigint, likes bigint, pipeline_tag string, library_name string, tags array<string>, createdAt string, lastModified string,
gated string, private boolean, disabled boolean, gguf boolean, safetensors struct<total: bigint>, config struct<architectures: array<string>, model_type: string>,
baseModels struct<relation: string, ids: array<string>>, cardData struct<base_model: string, language: string, license: string, `model-index`: string>"""
CLAIMS = "array<struct<task: string, dataset: string, dataset_name: string, config: string, split: string, metrics: array<struct<type: string, value: string>>>>"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of (gzip) JSON lines with the file each came from; lines that don't parse are null rows and go."""
    return spark.read.schema(RECORD).json(path).withColumn("file", F.input_file_name()).where("id is not null")


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """The named columns of CSV files with a header."""
    return spark.read.schema(schema).option("header", True).csv(path).select(*columns)


def claims(records: DataFrame, index: Column) -> DataFrame:
    """(model, dataset, task, metric, value): one row for each result of a record's model index (JSON text)."""
    parsed = records.select(normal_id(F.col("id")).alias("model"), F.explode(F.from_json(index, CLAIMS)).alias("e"))
    flat = parsed.where("e.dataset is not null and e.task is not null").select("model", F.col("e.dataset").alias("dataset"), F.col("e.task").alias("task"), F.explode("e.metrics").alias("m"))
    return flat.select("model", "dataset", "task", F.col("m.type").alias("metric"), number(F.col("m.value")).alias("value")).where("metric is not null and value is not null")


def list_or_scalar(raw: Column) -> Column:
    """JSON text that is a string or a list of strings, as an array."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(F.regexp_replace(raw, '^"|"$', "")))


def write_with_manifest(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet and return (file, rows, sha256) of the parts, read back from the store."""
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    rows = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    sums = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.element_at(F.split("path", "/"), -1).alias("part"), F.sha2("content", 256).alias("sha256"))
    return rows.withColumn("part", F.element_at(F.split("file", "/"), -1)).join(sums, "part").select("part", "rows", "sha256")
