"""Evidence, merging, priors and splits over the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import checks, evidence, prior, vocabulary as taxonomy_tables
from lakewright.plans import inputs
from lakewright.plans.inputs import with_ctes
from lakewright.storage import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


@query(with_ctes("edges") + " select dataset, task, model, metric, round(weight, 6) as weight from (select *, row_number() over (partition by dataset, task order by weight desc, model) as r from edges) where r = 1")
def best_model_per_node(spark, sf):
    return evidence.best_models(inputs.edges(spark, sf)).select(*evidence.NODE, "model", "metric", r6("weight"))


@query(with_ctes("ded") + " select model, dataset, task, metric, round(value, 6) as value, n_records from ded")
def dedupe_median(spark, sf):
    return evidence.dedupe_median(inputs.observations(spark, sf)).select("model", "dataset", "task", "metric", r6("value"), "n_records")


@query(with_ctes("w") + " select model, dataset, task, metric, direction, round(weight, 6) as weight from w")
def oriented_weights(spark, sf):
    w = evidence.weighted(inputs.deduplicated(spark, sf))
    return w.select("model", "dataset", "task", "metric", "direction", r6("weight"))


@query(with_ctes("prim") + " select * from prim")
def primary_metric(spark, sf):
    return evidence.primary_metric(evidence.weighted(inputs.deduplicated(spark, sf)))


@query(with_ctes("edges") + " select dataset, task, count(distinct model) as n_models, min(direction) as direction, min(direction) <> 'unknown' and count(distinct model) >= 3 as gold_eligible from edges group by all")
def node_eligibility(spark, sf):
    return evidence.nodes(inputs.edges(spark, sf))


_TASKS, _SETS = ("Reinforcement-Learning", "rl", "deep-rl", "Deep_RL", "robotics", "ner"), ("Unknown", " custom ", "#", "", "real")


@query(f"""with m as (select ({inputs.sql_list(_TASKS)})[o_orderkey % 6 + 1] as task, ({inputs.sql_list(_SETS)})[o_custkey % 5 + 1] as dataset from orders)
 select dataset, task, count(*) as n, lower(task) like 'reinforc%' or lower(task) in ('rl', 'deep-rl', 'deep_rl') as is_rl,
 lower(trim(dataset)) in ('unknown', 'custom') as is_placeholder, lower(trim(dataset)) in ('unknown', 'custom', '#', '##', '-', '') as is_merged_placeholder
 from m group by all""")
def task_and_dataset_flags(spark, sf):
    task = inputs.pick(_TASKS, F.col("o_orderkey") % 6).alias("task")
    g = table(spark, sf, "orders").groupBy(inputs.pick(_SETS, F.col("o_custkey") % 5).alias("dataset"), task).agg(F.count("*").alias("n"))
    placed = g.withColumn("is_rl", evidence.is_rl(F.col("task"))).withColumn("is_placeholder", evidence.is_placeholder(F.col("dataset")))
    return placed.withColumn("is_merged_placeholder", evidence.is_placeholder(F.col("dataset"), merged=True))


_MERGED = """, per as (select dataset, task, source, model, median(value) as value, count(*) as n_records from obs group by all),
 m as (select *, coalesce((value - min(value) over g) / nullif(max(value) over g - min(value) over g, 0), 0.5) as weight, case source when 's1' then 0 when 's2' then 1 else 2 end as priority
 from per window g as (partition by dataset, task, source)), mr as (select *, row_number() over (partition by dataset, task, model order by priority, source) as source_rank from m)"""


def _merged(spark, sf):
    order = F.when(F.col("source") == "s1", 0).when(F.col("source") == "s2", 1).otherwise(2)
    return evidence.merge_sources(inputs.observations(spark, sf), order)


@query(with_ctes("obs") + _MERGED + " select dataset, task, source, model, round(weight, 6) as weight, n_records from mr where source_rank = 1")
def merged_evidence(spark, sf):
    return _merged(spark, sf).where("source_rank = 1").select(*evidence.NODE, "source", "model", r6("weight"), "n_records")


@query(with_ctes("obs") + _MERGED + " select source, source_rank, count(*) as n from mr where source_rank > 1 group by all")
def source_conflicts(spark, sf):
    return _merged(spark, sf).where("source_rank > 1").groupBy("source", "source_rank").agg(F.count("*").alias("n"))


@query(with_ctes("obs") + _MERGED + " select dataset, task, count(distinct model) as n_models, count(distinct source) as n_sources, arg_min(source, priority) as gold_source from mr where source_rank = 1 group by all")
def gold_source_per_node(spark, sf):
    return evidence.gold_sources(_merged(spark, sf))


@query(with_ctes("edges") + """, b as (select *, ntile(20) over (partition by dataset, task order by weight, model) as bin from edges)
 select dataset, task, model, round(weight, 6) as weight from (select *, row_number() over (partition by dataset, task, bin order by md5(model::varchar), model) as r from b) where r = 1""")
def stratified_cap(spark, sf):
    return evidence.stratified_cap(inputs.edges(spark, sf), 20).select(*evidence.NODE, "model", r6("weight"))


@query(with_ctes("obs") + """, g as (select dataset, task, metric, case when dataset % 2 = 0 then value / 1e5 else value / 1e3 end as value from obs), s as (select *, median(value) over (partition by dataset, metric) as med from g),
 n as (select dataset, metric, value / case when med > 1.5 then 100 else 1 end as v from s) select dataset, metric, count(*) as n, round(avg(least(1, greatest(0, v))), 6) as mean_norm from n where v between -1e-3 and 1.001 group by all""")
def normalize_scale(spark, sf):
    o = inputs.observations(spark, sf).withColumn("value", F.when(F.col("dataset") % 2 == 0, F.col("value") / 1e5).otherwise(F.col("value") / 1e3))
    return evidence.normalize_scale(o, ["dataset", "metric"]).groupBy("dataset", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value_norm"), 6).alias("mean_norm"))


@query("with c as (select l_partkey as k, count(*) as n from lineitem group by all) select sum(n)::bigint as n, round(sum(n)::double * sum(n) / sum(n::double * n), 6) as effective, round(100.0 * max(n) / sum(n), 6) as top1_pct, round(100.0 * (select sum(n) from (from c order by n desc, k limit 10)) / sum(n), 6) as top10_pct from c")
def concentration(spark, sf):
    c = evidence.concentration(table(spark, sf, "lineitem"), "l_partkey")
    return c.select("n", r6("effective"), r6("top1_pct"), r6("top10_pct"))


@query("select p_type as value, count(*) as n from part group by all order by n desc, value limit 15")
def value_counts(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(15)


@query("select event_type, count(*) as n, count(*) filter (value > 50) as high, round(avg((value > 50)::int), 6) as share, count(*) filter (value is null) as nulls from events group by all")
def conditional_shares(spark, sf):
    high = F.col("value") > 50
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(high).alias("high"), F.round(F.avg(high.cast("int")), 6).alias("share"), F.count_if(F.col("value").isNull()).alias("nulls"))


@query("select o_orderpriority as node, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by all")
def node_stats(spark, sf):
    p = "o_totalprice"
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("node")).agg(F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("std"), F.min(p).alias("lo"), F.max(p).alias("hi"))


@query("select p_brand as root, count(*) as n, round(ln(1 + count(*)), 6) as log_size from part group by all")
def log_root_size(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("root")).agg(F.count("*").alias("n"), F.round(F.log1p(F.count("*")), 6).alias("log_size"))


@query("""select source, round(avg(length(text)), 4) as mean, median(length(text)) as median, round(stddev_pop(length(text)), 4) as std, round(quantile_cont(length(text), 0.1), 4) as p10, round(quantile_cont(length(text), 0.9), 4) as p90,
 round(avg((contains(text, chr(10)))::int), 6) as with_lines from documents group by all""")
def text_length_stats(spark, sf):
    d = table(spark, sf, "documents").withColumn("len", F.length("text"))
    return d.groupBy("source").agg(F.round(F.avg("len"), 4).alias("mean"), F.median("len").alias("median"), F.round(F.stddev_pop("len"), 4).alias("std"), F.round(F.percentile("len", F.lit(0.1)), 4).alias("p10"), F.round(F.percentile("len", F.lit(0.9)), 4).alias("p90"), F.round(F.avg(F.contains("text", F.lit("\n")).cast("int")), 6).alias("with_lines"))


_PRIOR = with_ctes("edges") + ", g as (select model, dataset, task, sum(weight) as t, count(*) as n from edges group by grouping sets ((task, model), (dataset, model), (model), ()))"


@query(_PRIOR + " select model, dataset, task, n, round((t + 2.5) / (n + 5), 6) as prior from g")
def shrunken_priors(spark, sf):
    p = prior.priors(inputs.edges(spark, sf), [["task", "model"], ["dataset", "model"], ["model"], []])
    return p.select("model", "dataset", "task", "n", r6("prior"))


@query(with_ctes("edges") + """, p as (select task, model, dataset, sum(weight) as ot, count(*) as o from edges group by all), w2 as (select task, model, sum(ot) as t, sum(o) as n from p group by all)
 select task, model, dataset, (n - o)::bigint as others, round((t - ot + 2.5) / (n - o + 5), 6) as prior from p join w2 using (task, model)""")
def leave_one_out_prior(spark, sf):
    return prior.leave_one_out(inputs.edges(spark, sf), ["task", "model"], ["dataset"]).select("task", "model", "dataset", "others", r6("prior"))


@query(with_ctes("edges") + " select model, count(*) as n, round((sum(weight) + 2.5) / (count(*) + 5), 6) as prior from edges where dataset % 7 in (1, 2) group by all")
def subset_prior(spark, sf):
    e = inputs.edges(spark, sf).where((F.col("dataset") % 7).isin(1, 2))
    return e.groupBy("model").agg(F.sum("weight").alias("t"), F.count("*").alias("n")).select("model", "n", F.round(prior.shrunken(F.col("t"), F.col("n")), 6).alias("prior"))


_SPLIT = """, s as (select dataset as root, count(*) as n from edges group by all), o as (select *, md5('1:' || root) as o, sum(n) over () as total from s),
 t as (select *, coalesce(sum(n) over (order by o, root rows between unbounded preceding and 1 preceding), 0) < 0.2 * total as test from o),
 v as (select *, coalesce(sum(n) over (partition by test order by o, root rows between unbounded preceding and 1 preceding), 0) as before from t),
 split as (select root, n, case when test then 'test' when before < 0.1 * total then 'val' else 'train' end as side from v)"""


def _split(spark, sf):
    return prior.split_roots(inputs.edges(spark, sf).groupBy(F.col("dataset").alias("root")).agg(F.count("*").alias("n")), 1)


@query(with_ctes("edges") + _SPLIT + " select * from split")
def root_split(spark, sf):
    return _split(spark, sf)


@query(with_ctes("edges") + _SPLIT + " select task, model, count(*) as n, round((sum(weight) + 2.5) / (count(*) + 5), 6) as prior from edges join split on dataset = root where side <> 'test' group by all")
def visible_prior(spark, sf):
    e = inputs.edges(spark, sf).join(_split(spark, sf).where("side <> 'test'").select(F.col("root").alias("dataset")), "dataset")
    return e.groupBy("task", "model").agg(F.sum("weight").alias("t"), F.count("*").alias("n")).select("task", "model", "n", F.round(prior.shrunken(F.col("t"), F.col("n")), 6).alias("prior"))


@query(with_ctes("edges") + _SPLIT + " select 'visible_and_test_roots' as rule, count(*) as n from (select root from split where side = 'test' intersect select root from split where side <> 'test')")
def split_leakage(spark, sf):
    s = _split(spark, sf)
    return s.where("side = 'test'").select("root").intersect(s.where("side <> 'test'").select("root")).agg(F.count("*").alias("n")).select(F.lit("visible_and_test_roots").alias("rule"), "n")


@query(with_ctes("edges") + """ select unnest(['weight_in_range', 'metric_named', 'records_positive']) as rule, unnest([count(*) filter (not (weight between 0 and 1)), count(*) filter (metric = ''), count(*) filter (n_records < 1)]) as n from edges""")
def edge_violations(spark, sf):
    return checks.violations(inputs.edges(spark, sf), {"weight_in_range": F.col("weight").between(0, 1), "metric_named": F.col("metric") != "", "records_positive": F.col("n_records") >= 1})


@query(with_ctes("edges") + " select 'edges' as rule, count(*) as n from (select 1 from edges group by model, dataset, task having count(*) > 1) union all select 'orders', count(*) from (select 1 from orders group by o_orderkey having count(*) > 1)")
def duplicate_keys(spark, sf):
    return checks.report(
        checks.duplicate_keys(inputs.edges(spark, sf), ["model", "dataset", "task"]).select(F.lit("edges").alias("rule"), "n"),
        checks.duplicate_keys(table(spark, sf, "orders"), ["o_orderkey"]).select(F.lit("orders").alias("rule"), "n"),
    )


@query("select count(*) as unmatched from (select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null))")
def anti_join_customers(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return checks.missing(c, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"]).agg(F.count("*").alias("unmatched"))


@query("""with a as (select c_custkey, c_nationkey from customer), b as (select o_custkey, c_nationkey from orders join customer on o_custkey = c_custkey)
 select (select count(*) from (from a except all from b)) as only_left, (select count(*) from (from b except all from a)) as only_right""")
def table_differences(spark, sf):
    """Customers against the customers of orders, with repeats."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey").select("c_custkey", "c_nationkey")
    return checks.differences(c, o)


@query("select count(*) as rows, sum(('0x' || substr(md5(concat_ws(chr(31), s_suppkey::varchar, s_name, s_nationkey::varchar)), 1, 15))::hugeint)::varchar as digest from supplier")
def table_digest(spark, sf):
    return checks.digest(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@query(with_ctes("obs") + """ select 'raw' as stage, count(*) as n from obs union all select 'finite', count(*) from obs where isfinite(value) union all select 'deduplicated', count(*) from (select distinct model, dataset, task, metric from obs)""")
def source_recounts(spark, sf):
    o = inputs.observations(spark, sf)
    one = o.agg(F.count("*").alias("raw"), F.count_if(~F.isnan("value") & (F.abs("value") < float("inf"))).alias("finite"), F.countDistinct("model", "dataset", "task", "metric").alias("deduplicated"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in ("raw", "finite", "deduplicated")])))


@query("""with v as (select c_mktsegment as token, count(*) as n from customer group by all having count(*) >= 3), k as (select token, row_number() over (order by token) + 100 as id from v where token <> 'BUILDING')
 select token, id from k union all select token, 7 from v where token = 'BUILDING'""")
def append_only_vocabulary(spark, sf):
    """Ids of known tokens stay (BUILDING has 7 of a vocabulary up to 100); new tokens get the next ones."""
    old = spark.createDataFrame([("BUILDING", 7), ("last", 100)], "token string, id long")
    v = taxonomy_tables.vocabulary(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("token")), old, 3)
    return v.join(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("token")).distinct(), "token", "left_semi")


@query("""with a as (select l_shipdate::date as d, l_extendedprice * (1 - l_discount) as x from lineitem) select year(d)::int as y, count(*) as n, round(sum(x), 2) as total, round(avg(x), 4) as mean from a group by all""")
def yearly_totals(spark, sf):
    a = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return a.groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"), F.round(F.avg("x"), 4).alias("mean"))
