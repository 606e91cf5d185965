"""Audits, gates and reports: every rule a query, every report a small table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lakewright.operators.evidence import NODE, normalize_scale
from lakewright.operators.ordering import running


def csv_audit(rows: DataFrame, bounded: tuple[str, ...]) -> DataFrame:
    """(name, value): rows, null values, range, distinct models, datasets and tasks, depth quantiles, rows of bounded metrics.

    ``rows``: task, dataset, model, metric, value as read; one pass for the aggregates and one for the depths.
    """
    v = F.col("value").try_cast("double")
    one = rows.agg(
        F.count("*").cast("double").alias("rows"),
        F.count_if(v.isNull()).cast("double").alias("null_values"),
        F.min(v).alias("value_min"),
        F.max(v).alias("value_max"),
        F.countDistinct("model").cast("double").alias("models"),
        F.countDistinct("dataset").cast("double").alias("datasets"),
        F.countDistinct("task").cast("double").alias("tasks"),
        F.count_if(base_metric(F.col("metric")).isin(*bounded)).cast("double").alias("bounded_rows"),
    )
    depth = rows.groupBy("dataset").agg(F.countDistinct("model").alias("d"))
    two = depth.agg(F.percentile("d", F.lit(0.5)).alias("depth_p50"), F.percentile("d", F.lit(0.9)).alias("depth_p90"))
    return unpivot(one.crossJoin(two))


def base_metric(metric: Column) -> Column:
    """Lower-cased metric without its cut-off at k."""
    return F.regexp_replace(F.lower(F.trim(metric)), r"[@_](at_)?\d+$", "")


def unpivot(wide: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., name, value): one row for each other column."""
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in wide.columns if c not in keys]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def intake(rows: DataFrame, known: DataFrame, bounded: tuple[str, ...]) -> DataFrame:
    """Rows of bounded metrics, with a value, of known models, of their node's chosen metric, scaled to 0..1.

    Chosen: the full metric name with the most rows of the node, ties by name. A node whose median is over 1.5 counts as percent.
    """
    v = F.col("value").try_cast("double")
    kept = rows.withColumn("value", F.when(~F.isnan(v), v)).where(base_metric(F.col("metric")).isin(*bounded) & F.col("value").isNotNull())
    kept = kept.withColumn("metric", F.lower(F.trim("metric"))).join(known, "model", "left_semi")
    n = kept.groupBy(*NODE, "metric").agg(F.count("*").alias("c"))
    chosen = n.groupBy(*NODE).agg(F.min_by("metric", F.struct((-F.col("c")).alias("c"), "metric")).alias("metric"))
    return normalize_scale(kept.join(chosen, [*NODE, "metric"], "left_semi"), list(NODE))


def top_share(df: DataFrame, key: str, n: int) -> DataFrame:
    """(share): how much of the rows the n commonest values hold; ties don't matter."""
    by = df.groupBy(key).agg(F.count("*").alias("k"))
    top = by.orderBy(F.desc("k"), key).limit(n).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("t"))
    return top.crossJoin(df.agg(F.count("*").alias("n"))).select(F.try_divide("t", "n").alias("share"))


def gates(sel: DataFrame, pool: DataFrame, again: DataFrame, caps: dict[str, float], quotas: dict[str, dict[str, int]]) -> DataFrame:
    """(gate, value, ok) of the twenty exit gates of a selection.

    ``sel`` and ``pool``: model_id, near_key, exact_key, author, is_mirror, family, source_type, task, bucket, size_class, quality,
    resolved, flagged, provenance; ``again``: the rerun's model_id; ``quotas``: column -> wanted counts by value.
    """
    n = sel.count()
    one = lambda df, value: df.agg(value.cast("double").alias("value"))
    row = lambda name, df, ok: df.select(F.lit(name).alias("gate"), "value", F.coalesce(ok, F.lit(True)).alias("ok"))
    v = F.col("value")
    share = lambda c: F.count_if(c) / F.lit(max(n, 1))
    over = lambda key, cap: sel.groupBy(key).agg(F.count("*").alias("k")).where(F.col("k") > cap).agg(F.count("*").cast("double").alias("value"))
    both = over("near_key", caps["near"]).union(over("exact_key", caps["exact"])).agg(F.sum("value").alias("value"))
    largest = lambda df, key: df.groupBy(key).agg(F.count("*").alias("k")).agg((F.coalesce(F.max("k"), F.lit(0)) / F.lit(max(n, 1))).alias("value"))
    quant, official = F.col("source_type") == "quantized-conversion", F.col("source_type") == "official-quantized"
    major = sel.where(~F.col("task").isin("unknown", "other"))
    named = pool.where(~F.col("task").isin("unknown", "other"))
    rich = named.groupBy("task").agg(F.count("*").alias("k")).crossJoin(pool.agg(F.count("*").alias("all"))).where(F.col("k") / F.col("all") >= caps["rich"])
    got = sel.groupBy("task").agg(F.count("*").alias("g"))
    short = rich.join(got, "task", "left").where(F.coalesce("g", F.lit(0)) / F.lit(max(n, 1)) < caps["rich_floor"])
    spoken = sel.where(F.col("bucket").isin("english-primary", "multilingual-with-english", "non-english", "unknown"))
    part = lambda c: F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0))
    english = F.col("bucket").isin("english-primary", "multilingual-with-english")
    derived = F.col("source_type").isin("official-derivative", "community-finetune", "adapter-lora", "quantized-conversion", "unknown-derivative")
    open_, told = F.count_if(derived & ~F.col("resolved")), F.count_if(derived & ~F.col("resolved") & F.col("flagged"))
    spark = sel.sparkSession

    def deviation(column: str) -> DataFrame:
        want = spark.createDataFrame([(k, q) for k, q in quotas[column].items() if q > 0], f"{column} string, q long")
        have = want.join(sel.groupBy(column).agg(F.count("*").alias("g")), column, "left")
        return have.agg((F.coalesce(F.max(F.abs(F.coalesce("g", F.lit(0)) - F.col("q"))), F.lit(0)) / F.lit(max(n, 1))).alias("value"))

    same = sel.select("model_id").exceptAll(again).union(again.exceptAll(sel.select("model_id")))
    mirrors, ordinary = sel.where("is_mirror"), sel.where("not is_mirror")
    parts = [
        row("G1", one(sel, F.count("*") - F.countDistinct("model_id")), v == 0),
        row("G2", both, v == 0),
        row("G3", largest(ordinary, "author"), v <= caps["author"] + 1e-9),
        row("G4", top_share(sel, "author", 10).withColumnRenamed("share", "value"), v <= caps["top10"] + 1e-9),
        row("G5", largest(mirrors, "author"), v <= caps["mirror"] + 1e-9),
        row("G6", largest(sel, "family"), v <= caps["family"] + 1e-9),
        row("G7", one(sel, share(quant | official)), (v <= caps["quantized"] + 1e-9)),
        row("G8", largest(major, "task"), v <= caps["task"] + 1e-9),
        row("G9", one(short, F.count("*")), v == 0),
        row("G10", one(spoken, part(english)), v >= caps["english"] - 1e-9),
        row("G11", one(spoken, part(F.col("bucket") == "unknown")), v <= caps["unknown"] + 1e-9),
        row("G12", one(sel, share(F.col("task") == "unknown")), v <= caps["unknown_task"] + 1e-9),
        *[row(g, deviation(c), v <= caps["tolerance"] + 1e-9) for g, c in (("G13", "task"), ("G14", "bucket"), ("G15", "size_class"))],
        row("G16", one(sel, share(F.col("quality") >= caps["quality"])), v >= caps["pass_rate"] - 1e-9),
        row("G17", one(sel, open_ - told), v == 0),
        row("G18", one(sel, F.count("*")), v == caps["feasible"]),
        row("G19", one(same, F.count("*")), v == 0),
        row("G20", one(sel, F.count_if(F.col("provenance").isNull())), v == 0),
    ]
    return reduce(DataFrame.unionByName, parts)


def ladder(canon: DataFrame, extra: DataFrame, history: DataFrame) -> DataFrame:
    """(id, model, family, family_source, in_snapshot, origin): the snapshot in its own order, then the models only history knows.

    ``canon``: (place, model, family, family_source); ``extra``: (model); ``history``: (model, family, source, priority), of which
    the source of least priority counts. Ids are dense from 0.
    """
    best = history.groupBy("model").agg(F.min_by(F.struct("family", "source"), F.struct("priority", "source")).alias("h"))
    told = extra.join(best, "model", "left")
    late = told.select(
        F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), "model",
        F.coalesce("h.family", F.lit("other")).alias("family"),
        F.concat(F.lit("history:"), F.coalesce("h.source", F.lit("none"))).alias("family_source"),
        F.lit(False).alias("in_snapshot"), F.lit("historical_supervision").alias("origin"),
    )
    early = canon.select(
        F.lit(0).alias("part"), F.col("place").cast("long").alias("place"), "model", "family", "family_source",
        F.lit(True).alias("in_snapshot"), F.lit("snapshot").alias("origin"),
    )
    made = running(early.unionByName(late), [F.col("part"), F.col("place"), F.col("model")], number="id")
    return made.withColumn("id", F.col("id") - 1).drop("part", "place")


def ladder_checks(rungs: DataFrame, canon: DataFrame, extra: DataFrame, supervised: DataFrame) -> DataFrame:
    """(check, ok) of a ladder: its size, dense ids, distinct names, disjoint parts, a row for every supervised model."""
    norm = F.lower(F.trim("model"))
    facts = rungs.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.countDistinct("id").alias("d"), F.countDistinct(norm).alias("names")).first()
    size = canon.count() + extra.count()
    missing = supervised.select("model").join(rungs.select("model"), "model", "left_anti").take(1)
    shared = extra.select("model").join(canon.select("model"), "model", "left_semi").take(1)
    rows = [
        ("rows_equal_expected", facts.n == size),
        ("ids_are_dense", not size or (facts.lo, facts.hi, facts.d) == (0, size - 1, size)),
        ("names_are_unique", facts.names == facts.n),
        ("parts_are_disjoint", not shared),
        ("supervised_have_rows", not missing),
    ]
    return rungs.sparkSession.createDataFrame(rows, "check string, ok boolean")


def contract(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(column, problem): columns that are missing or of another type than a stage expects."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bad = [(c, "missing" if c not in have else f"{have[c]} for {t}") for c, t in wanted.items() if have.get(c) != t]
    return df.sparkSession.createDataFrame(bad, "column string, problem string")


def bijection(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a_with_many, b_with_many): values of either side that have two partners or more."""
    many = lambda x, y: pairs.groupBy(x).agg(F.countDistinct(y).alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    return many(a, b).withColumnRenamed("n", "a_with_many").crossJoin(many(b, a).withColumnRenamed("n", "b_with_many"))


def union_crawl(queries: dict[str, DataFrame], cap: dict[str, int], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(records, membership): the first ``cap`` records of each query's result; an id is kept once, as the first query saw it."""
    parts = [df.orderBy(*order).limit(cap[name]).withColumn("query", F.lit(name)).withColumn("turn", F.lit(i)) for i, (name, df) in enumerate(queries.items())]
    every = reduce(DataFrame.unionByName, parts)
    rest = [c for c in every.columns if c not in ("id", "turn")]
    one = every.groupBy("id").agg(F.min_by(F.struct(*rest), F.col("turn")).alias("r"), F.min("turn").alias("first_turn"))
    return one.select("id", "r.*", "first_turn").withColumnRenamed("query", "first_seen_query"), every.select("id", "query").distinct()


def query_plan(tasks: DataFrame, sorts: tuple[str, ...], cap: int) -> DataFrame:
    """(name, task, sort, cap): one crawl query for each task and order, as a table of parameters."""
    each = tasks.select("task").distinct().withColumn("sort", F.explode(F.array(*map(F.lit, sorts))))
    return each.select(F.concat_ws(":", "task", "sort").alias("name"), "task", "sort", F.lit(cap).alias("cap"))


def cached_fetch(wanted: DataFrame, cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """What a cache knows of the wanted ids, and for the others what was fetched now."""
    known = cache.join(wanted, "id", "left_semi")
    return known.unionByName(fetched.join(wanted.join(cache, "id", "left_anti"), "id", "left_semi").select(*known.columns))


def aligned(ids: DataFrame, facts: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Facts by normalised id in the rows of ``ids``; defaults where there are none."""
    told = facts.withColumn("_k", F.lower(F.trim("id"))).drop("id")
    j = ids.withColumn("_k", F.lower(F.trim("id"))).join(told, "_k", "left").drop("_k")
    return j.fillna(defaults)
