"""The corpus pipeline: five stages, each over all that its predecessor kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewright.llm import jaccard, language, mixing, packing, quality
from lakewright.storage import release, scope, scratch, table

#: Least share of a document's main language; least quality score.
LANGUAGE_SHARE, QUALITY = 0.5, 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language: a learned one holds at least LANGUAGE_SHARE of the text.

    Null and empty texts, texts without letters, and all texts when nothing can be learned have none and go.
    """
    found = language.identify(docs.withColumns({f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE))
    return kept.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose co-trained quality score is QUALITY or more; all of them without labels of both classes.

    Null text counts as empty; rows with null doc_id are scored like others; repeated rows score alike.
    """
    found = quality.score(docs.withColumns({f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}), table(spark, sf_dir, "labels"), threshold=QUALITY)
    return found.where("keep").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component by 5-word shingles at a Jaccard of 0.8: the one with the smallest doc_id.

    Of rows that repeat a doc_id the one with the least text hash stays (ties: equal texts, either's other columns). Documents
    without words and rows with null doc_id stay as they are.
    """
    found = jaccard.jaccard_components(docs, n=5, num=80, den=100)
    gone = found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_k")).where("_k > 1")
    marked = docs.join(gone, "doc_id", "left_anti").join(repeated, "doc_id", "left").select(*docs.columns, "_k")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = marked.where("_k is not null").groupBy("doc_id").agg(F.min_by(whole, F.xxhash64("text")).alias("_r"))
    return marked.where("_k is null").select(*docs.columns).unionByName(one.select("_r.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their target weights.

    Null source is a source; documents without words are drawn too; rows of one doc_id, source and size share their copies.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of permitted lengths: one row a piece.

    Null texts and texts without words get a row with null bin; repeated rows are packed one by one.
    """
    return packing.packed(docs)


STAGES = [("language ID", language_id), ("quality classifier", quality_filter), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack)]

#: Stages on learned or drawn decisions have no SQL form: tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage's rows are written to the shared folder and read again.

    A stage's own tables go when its rows are written, and its rows when the next one's are.
    """
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scope() as kept:
            path = scratch(spark, "stage")
        with scope() as own:
            try:
                out = stage(spark, docs, sf_dir)
                out.write.parquet(path)
            finally:
                release(spark, own)
        if held:
            release(spark, held)
        docs, held = spark.read.schema(out.schema).parquet(path), kept
    return STAGES[-1][1](spark, docs, sf_dir)
