"""Evidence relation: from raw observations to one oriented weight for each (node, model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.functions.metrics import direction, known, orient

NODE = ("dataset", "task")
# fixed values: dataset names that name no dataset; those that merged sources add; reinforcement learning's names
PLACEHOLDERS = (
    "unknown", "custom", "none", "null", "n/a", "na", "private", "internal",
    "test", "dataset", "my_dataset", "mydataset", "local", "own", "self",
    "in-house", "in_house", "proprietary", "confidential",
)
MERGED_PLACEHOLDERS = ("##", "#", "-", "")
RL_TASKS = ("rl", "deep-rl", "deep_rl")


def is_rl(task: Column) -> Column:
    """Tasks of reinforcement learning, by prefix or name."""
    t = F.lower(F.trim(F.coalesce(task, F.lit(""))))
    return t.startswith("reinforc") | t.isin(*RL_TASKS)


def is_placeholder(dataset: Column, merged: bool = False) -> Column:
    """Names that every author gives to other data; in merged sources also bare marks."""
    name = F.lower(F.trim(dataset))
    return name.isin(*PLACEHOLDERS, *(MERGED_PLACEHOLDERS if merged else ()))


def dedupe_median(obs: DataFrame) -> DataFrame:
    """One row for each (model, dataset, task, metric): the median value and the number of records."""
    return obs.groupBy("model", *NODE, "metric").agg(F.median("value").alias("value"), F.count("*").alias("n_records"))


def min_max(df: DataFrame, by: list[str], value: str = "value", out: str = "norm") -> DataFrame:
    """``value`` scaled to 0..1 within the groups ``by``; 0.5 in constant groups.

    Bounds are aggregated with map-side combine and joined, so a group of any size needs no single task.
    """
    span = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.coalesce((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.5))
    return df.join(span, by).withColumn(out, at).drop("_lo", "_hi")


def weighted(ded: DataFrame) -> DataFrame:
    """Deduplicated rows with direction and oriented weight."""
    d = min_max(ded, [*NODE, "metric"]).withColumn("direction", direction(F.col("metric")))
    return d.withColumn("weight", orient(F.col("norm"), F.col("direction"))).drop("norm")


def primary_metric(w: DataFrame) -> DataFrame:
    """(dataset, task, metric, direction, n) of each node: known direction first, then most rows, then name."""
    n = w.groupBy(*NODE, "metric", "direction").agg(F.count("*").alias("n"))
    rank = F.struct((~known(F.col("direction"))).cast("int").alias("a"), (-F.col("n")).alias("b"), F.col("metric").alias("c"))
    return n.groupBy(*NODE).agg(F.min_by(F.struct("metric", "direction", "n"), rank).alias("p")).select(*NODE, "p.*")


def primary_edges(w: DataFrame) -> DataFrame:
    """The rows of each node's primary metric."""
    return w.join(primary_metric(w).select(*NODE, "metric"), [*NODE, "metric"], "left_semi")


def nodes(edges: DataFrame, min_models: int = 3, merged: bool = False) -> DataFrame:
    """Each node's models, flags and eligibility as a query; merged nodes also accept a curated direction."""
    n = edges.groupBy(*NODE).agg(F.countDistinct("model").alias("n_models"), F.min("direction").alias("direction"))
    named = ~is_placeholder(F.col("dataset").cast("string"), merged)
    ok = known(F.col("direction"), merged) & ~is_rl(F.col("task").cast("string")) & named
    return n.withColumn("gold_eligible", ok & (F.col("n_models") >= min_models))


def best_models(edges: DataFrame) -> DataFrame:
    """The best model of each node; ties go to the smaller model."""
    top = F.max_by(F.struct("model", "weight", "metric"), F.struct(F.col("weight"), (-F.col("model")).alias("m"))).alias("t")
    return edges.groupBy(*NODE).agg(top).select(*NODE, "t.*")


def normalize_scale(obs: DataFrame, by: list[str], limit: float = 1.5, slack: float = 1e-3) -> DataFrame:
    """Values of groups whose median is over ``limit`` count as percent; values out of 0..1 by more than the slack go."""
    med = obs.groupBy(*by).agg(F.median("value").alias("_med"))
    v = F.col("value") / F.when(F.col("_med") > limit, 100.0).otherwise(1.0)
    return obs.join(med, by).withColumn("value_norm", v).where(F.col("value_norm").between(-slack, 1 + slack)).withColumn("value_norm", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "value_norm"))).drop("_med")


def stratified_cap(edges: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` edges a node: the weight-sorted node in ``cap`` even bins, one edge of each bin by a hash of the model."""
    by = Window.partitionBy(*NODE)
    binned = edges.withColumn("_bin", F.ntile(cap).over(by.orderBy("weight", "model")))
    pick = F.struct(F.md5(F.col("model").cast("string")), "model")
    rest = [c for c in edges.columns if c not in NODE]
    one = binned.groupBy(*NODE, "_bin").agg(F.min_by(F.struct(*rest), pick).alias("_e"))
    return one.select(*NODE, "_e.*").select(*edges.columns)


def merge_sources(obs: DataFrame, priority: Column) -> DataFrame:
    """One row for each (node, source, model): median value, scaled within (node, source), with its priority and rank.

    Rank 1 is kept, the others are conflicts between sources.
    """
    per = obs.groupBy(*NODE, "source", "model").agg(F.median("value").alias("value"), F.count("*").alias("n_records"))
    per = min_max(per, [*NODE, "source"], out="weight").withColumn("priority", priority)
    order = Window.partitionBy(*NODE, "model").orderBy("priority", "source")
    return per.withColumn("source_rank", F.row_number().over(order))


def fold_metrics(ded: DataFrame) -> DataFrame:
    """One row for each (node, model): median weight, the first metric and its direction, records of all metrics."""
    pick = F.min(F.struct("metric", "direction"))
    g = ded.groupBy(*NODE, "model").agg(F.median("weight").alias("weight"), pick.alias("m"), F.sum("n_records").alias("n_records"))
    return g.select(*NODE, "model", "weight", "m.metric", "m.direction", "n_records")


def with_counts(edges: DataFrame) -> DataFrame:
    """Edges with how many models their node has: a left join, as every edge stays."""
    n = edges.groupBy(*NODE).agg(F.countDistinct("model").alias("n_models"))
    return edges.join(n, list(NODE), "left")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that fails where a key repeats on either side: checked by counts before."""
    for side, df in (("left", left), ("right", right)):
        if df.groupBy(*on).agg(F.count("*").alias("k")).where("k > 1").take(1):
            raise ValueError(f"the join is not one to one: keys repeat on the {side}")
    return left.join(right, on, "left")


def descriptions(rows: DataFrame, order: str, limit: int = 2000) -> DataFrame:
    """(dataset, description): the first text that is not blank, by ``order``, stripped and cut to ``limit`` characters."""
    kept = rows.where(F.length(F.trim("description")) > 0)
    text = F.min_by(F.substring(F.trim("description"), 1, limit), F.col(order)).alias("description")
    return kept.groupBy("dataset").agg(text)


def gold_sources(merged: DataFrame) -> DataFrame:
    """Each node's models, sources and its source of highest priority."""
    return merged.where("source_rank = 1").groupBy(*NODE).agg(F.countDistinct("model").alias("n_models"), F.countDistinct("source").alias("n_sources"), F.min_by("source", F.struct("priority", "source")).alias("gold_source"))


def concentration(df: DataFrame, key: str) -> DataFrame:
    """(n, effective, top1_pct, top10_pct): how far rows are spread over the values of ``key``."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), key))
    top = n.orderBy(F.desc("n"), key).limit(10).withColumn("r", rank).agg(F.sum("n").alias("t10"), F.max("n").alias("t1"))
    all_ = n.agg(F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    return all_.crossJoin(top).select(F.col("total").alias("n"), (F.col("total").cast("double") * F.col("total") / F.col("sq")).alias("effective"), (100.0 * F.col("t1") / F.col("total")).alias("top1_pct"), (100.0 * F.col("t10") / F.col("total")).alias("top10_pct"))
