"""Evaluation of rankings: fused pools, full ranks, sweeps, strata, baselines, gates, scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions.vector import masked
from lakewright.operators import evaluation, ranking, retrieval, vectors
from lakewright.plans import inputs
from lakewright.plans.evidence_queries import r6
from lakewright.plans.inputs import with_ctes
from lakewright.plans.retrieval_queries import _FUSED, _RANKS, _TIE, POOL, _fused, _labelled, _query_prior, _ranks, _search, _SL
from lakewright.storage import cut, table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_GOLD = ", gold as (select query, arg_max(item, (value, -item)) as item from lab group by query)"


def _gold(spark, sf):
    pick = F.struct("value", (-F.col("item")).alias("i"))
    return inputs.labels(spark, sf).groupBy("query").agg(F.max_by("item", pick).alias("item"))


_POOLED = _FUSED + _GOLD + f", pg as (select gold.query, fr.rank is not null as in_pool, coalesce(fr.rank, least({POOL}, (select count(*) from vec)) + 1) as gold_rank from gold left join fr using (query, item))"


def _pooled(spark, sf):
    whole = cut(_fused(spark, sf, POOL), "reranked")
    size = whole.groupBy("query").agg(F.count("*").alias("k"))
    return retrieval.gold_in_pool(whole, size, _gold(spark, sf))


@query(with_ctes("sc", "pri", "lab") + _POOLED + " select * from pg")
def fused_gold(spark, sf):
    """Where the best labelled item stands in the reranked pool; a pool miss has the rank after the last."""
    return _pooled(spark, sf)


@query(
    with_ctes("sc", "pri", "lab")
    + _POOLED
    + """ select count(*) as n, round(avg(in_pool::int), 6) as in_pool, round(avg((gold_rank <= 1)::int), 6) as gold_1,
 round(avg((gold_rank <= 10)::int), 6) as gold_10, median(least(gold_rank, 11)) as median_top10_rank from pg"""
)
def fused_gold_at_k(spark, sf):
    """Shares over all queries, misses in the denominator; ranks beyond ten count as eleven."""
    hit = lambda k: F.round(F.avg((F.col("gold_rank") <= k).cast("int")), 6).alias(f"gold_{k}")
    first = F.median(F.least(F.col("gold_rank"), F.lit(11))).alias("median_top10_rank")
    return _pooled(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(F.col("in_pool").cast("int")), 6).alias("in_pool"), hit(1), hit(10), first)


_RANKED = (
    f""", al as (select sc.query, sc.item, score, ((score::float + 1::float) / 2::float)::float + coalesce(prior, 0)::float as fused, coalesce(prior, 0) as prior, {_TIE.replace("item", "sc.item")} as tie
 from sc join q using (query) left join pri on pri.task = q.task and pri.item = sc.item),
 full_ranks as (select g.query, g.item, count(*) filter (a.score > me.score) + 1 as rank,
 count(*) filter (a.fused > me.fused or a.fused = me.fused and a.tie < me.tie) + 1 as fused_rank,
 count(*) filter (a.prior > me.prior or a.prior = me.prior and a.tie < me.tie) + 1 as prior_rank
 from gold g join al me on me.query = g.query and me.item = g.item join al a on a.query = g.query group by all)"""
)
_FULL = _GOLD + _RANKED


def _full(spark, sf):
    q, v = inputs.queries(spark, sf), inputs.vectors(spark, sf)
    return cut(retrieval.full_ranks(q, v, _gold(spark, sf), inputs.priors(spark, sf)), "ranks")


@query(with_ctes("sc", "pri", "lab") + _FULL + " select * from full_ranks")
def full_lake_ranks(spark, sf):
    """Ranks of the best labelled item among all items: by score, by the fused score, by the prior alone."""
    return _full(spark, sf)


@query(
    with_ctes("sc", "pri", "lab")
    + _POOLED
    + _RANKED
    + """ select round(avg((gold_rank <= 10)::int), 6) as pooled, round(avg((fused_rank <= 10)::int), 6) as whole,
 round(avg((gold_rank <= 10)::int) / nullif(avg((fused_rank <= 10)::int), 0), 6) as retention, coalesce(avg((gold_rank <= 10)::int) / nullif(avg((fused_rank <= 10)::int), 0) >= 0.9, false) as passes
 from pg join full_ranks using (query)"""
)
def retention_gate(spark, sf):
    """Pooled over whole-lake share of gold in ten, held against 0.9."""
    j = _pooled(spark, sf).join(_full(spark, sf), "query")
    a, b = (F.avg((F.col(c) <= 10).cast("int")) for c in ("gold_rank", "fused_rank"))
    g = j.agg(a.alias("a"), b.alias("b")).withColumn("r", F.try_divide("a", "b"))
    return g.select(r6("a", "pooled"), r6("b", "whole"), r6("r", "retention"), F.coalesce(F.col("r") >= 0.9, F.lit(False)).alias("passes"))


_BETAS = (0.0, 0.25, 0.5, 1.0, 4.0, 1e6)


@query(
    with_ctes("sc", "pri", "lab")
    + _FUSED
    + _GOLD
    + f""", u as (select f.query, f.item, coalesce((score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0), 0.5) as s, coalesce(prior, 0) as p
 from pool f join q using (query) left join pri on pri.task = q.task and pri.item = f.item window w as (partition by f.query)),
 b as (select unnest([{", ".join(map(str, _BETAS))}])::double as beta),
 r as (select beta, query, item, row_number() over (partition by beta, query order by round(s + beta * p, 9) desc, {_TIE}) as r from u, b)
 select beta, round(count(r.item)::double / (select count(*) from gold), 6) as gold_10 from b left join (select r.beta as rb, r.item, r.query from r join gold using (query, item) where r <= 10) r on rb = beta group by all"""
)
def fusion_sweep(spark, sf):
    """Share of gold in ten by weight of the prior, from none to all."""
    pool = cut(_search(spark, sf, POOL), "pool")
    return retrieval.fusion_sweep(pool, _query_prior(spark, sf), _gold(spark, sf), _BETAS).select("beta", r6("gold_10"))


_SIZES = (10, 50, 100, 500)


@query(
    with_ctes("sc", "pri", "lab")
    + _FULL
    + f""", k as (select unnest([{", ".join(map(str, _SIZES))}]) as k), g as (select k, count(*) as n, avg((rank <= k and fused_rank <= 10)::int) as gold from full_ranks, k group by all),
 w as (select avg((fused_rank <= 10)::int) as whole from full_ranks)
 select k::int as k, n, round(gold, 6) as gold, round(gold - lag(gold) over (order by k), 6) as gain,
 round((gold - first(gold) over (order by k)) / nullif(whole - first(gold) over (order by k), 0), 6) as closed from g, w"""
)
def pool_size_curve(spark, sf):
    """What larger pools gain, and how much of the gap to the whole lake they close."""
    ranks = _full(spark, sf).select("query", F.col("rank").alias("dense_rank"), F.col("fused_rank").alias("full_rank"))
    return evaluation.pool_curve(ranks, _SIZES).select("k", "n", r6("gold"), r6("gain"), r6("closed"))


@query(
    with_ctes("sc", "lab")
    + """, c as (select item from vec where label % 3 <> 0), s2 as (select sc.* from sc semi join c using (item)), g as (select query, arg_max(item, (value, -item)) as item from lab semi join c using (item) group by query),
 rk as (select g.query, count(*) filter (o.score > me.score) + 1 as rank from g join s2 me on me.query = g.query and me.item = g.item join s2 o on o.query = g.query group by all)
 select (select count(*) from c) as pool, count(*) as n, round(avg((rank <= 10)::int), 6) as gold_10, round(avg((rank <= 100)::int), 6) as gold_100, median(rank) as median_rank from rk"""
)
def restricted_pool(spark, sf):
    """Retrieval where only some classes of items are candidates: both items and labels are restricted by a semi join."""
    some = inputs.vectors(spark, sf).where("label % 3 <> 0")
    labels = inputs.labels(spark, sf).join(some.select("item"), "item", "left_semi")
    pick = F.struct("value", (-F.col("item")).alias("i"))
    gold = labels.groupBy("query").agg(F.max_by("item", pick).alias("item"))
    r = retrieval.full_ranks(inputs.queries(spark, sf), some, gold)
    hit = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"gold_{k}")
    one = r.agg(F.count("*").alias("n"), hit(10), hit(100), F.median("rank").alias("median_rank"))
    return some.agg(F.count("*").alias("pool")).crossJoin(one)


_FIVE = (
    _SL
    + _RANKS
    + """, pl as (select *, row_number() over (partition by query order by value desc, item) as place from sl),
 five as (select pl.query, count(*) as n_candidates, (arg_max(value, (score, -item)) = max(value))::int as hit1, (arg_max(place, (score, -item)) <= 3)::int as top3_hit1,
 max(value) - arg_max(value, (score, -item)) as regret1, 1.0 / gold_rank as reciprocal_rank, gold_rank, gap_rank from pl join qr on qr.query = pl.query group by all)"""
)


def _five(spark, sf):
    return evaluation.five_metrics(_labelled(spark, sf), _ranks(spark, sf))


@query(with_ctes("sc", "lab") + _FIVE + " select query, n_candidates, hit1, top3_hit1, round(regret1, 6) as regret1, round(reciprocal_rank, 6) as reciprocal_rank, gold_rank, gap_rank from five")
def five_metrics(spark, sf):
    f = _five(spark, sf)
    return f.select("query", "n_candidates", "hit1", "top3_hit1", r6("regret1"), r6("reciprocal_rank"), "gold_rank", "gap_rank")


@query(
    with_ctes("sc", "lab")
    + _FIVE
    + """ select case when n_candidates between 2 and 4 then '2-4' when n_candidates between 5 and 9 then '5-9' when n_candidates between 10 and 49 then '10-49' when n_candidates >= 50 then '50-inf' end as stratum,
 count(*) as n, round(avg(hit1), 6) as hit1, round(avg(top3_hit1), 6) as top3_hit1, round(avg(regret1), 6) as regret1 from five group by all"""
)
def candidate_strata(spark, sf):
    f = _five(spark, sf).groupBy(evaluation.band(F.col("n_candidates")).alias("stratum"))
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return f.agg(F.count("*").alias("n"), mean("hit1"), mean("top3_hit1"), mean("regret1"))


@query(
    with_ctes("sc", "lab")
    + _SL
    + """, d as (select query, value, row_number() over (w order by score desc, item) as r, row_number() over (w order by value desc, item) as i, count(*) over w as n,
 max(value) over w as best, min(value) over w as worst from sl window w as (partition by query)), k as (select unnest([1, 5, 10]) as k)
 select query, k::int as k, max((r <= k and i = 1)::int) as hit, round(count(*) filter (r <= k and i <= least(3, n)) / max(least(3, n)), 6) as recall_top3,
 round(count(*) filter (r <= k and i <= greatest(1, ceil(n * 0.1 - 1e-9))) / max(greatest(1, ceil(n * 0.1 - 1e-9))), 6) as recall_top10pct,
 round(sum(case when r <= k then value / log2(r + 1) else 0 end) / sum(case when i <= k then value / log2(i + 1) else 0 end), 6) as ndcg,
 round(max(best) - max(value) filter (r <= k), 6) as regret from d, k where n >= 3 and best > worst group by all"""
)
def top_metrics(spark, sf):
    """hit, recalls, NDCG and regret at 1, 5 and 10 over the labelled candidates."""
    h = evaluation.head_retrieval(_labelled(spark, sf))
    return h.select("query", "k", "hit", *[r6(c) for c in ("recall_top3", "recall_top10pct", "ndcg", "regret")])


@query(
    with_ctes("sc", "lab")
    + _GOLD
    + """, s as (select query, item, row_number() over (partition by query order by score desc, item) as pos from sc), g as (select s.query, pos from s join gold using (query, item)), k as (select unnest([10, 50, 100, 500]) as k)
 select k::int as k, round(avg((pos <= k)::int), 6) as survival from g, k group by all"""
)
def gold_survival(spark, sf):
    """How often the best item's position, ties by id, is within k."""
    v, q = inputs.vectors(spark, sf), inputs.queries(spark, sf)
    found = retrieval.blocked_top_k(q, v, 500).join(_gold(spark, sf), ["query", "item"]).select("query", "rank")
    every = _gold(spark, sf).join(found, "query", "left").withColumn("k", F.explode(F.array(*map(F.lit, (10, 50, 100, 500)))))
    return every.groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("int"), F.lit(0))), 6).alias("survival"))


@query(
    with_ctes("sc", "pri", "lab")
    + _FULL
    + """ select count(*) filter (rank <= 50 and fused_rank <= 50) as both, count(*) filter (rank > 50 and fused_rank <= 50) as rescue, count(*) filter (rank <= 50 and fused_rank > 50) as harm,
 count(*) filter (rank > 50 and fused_rank > 50) as neither, median(rank) as median_a, median(fused_rank) as median_b from full_ranks"""
)
def paired_systems(spark, sf):
    """Score against fused score on equal query sets: rescued and harmed queries."""
    f = _full(spark, sf)
    return evaluation.paired(f.select("query", "rank"), f.select("query", F.col("fused_rank").alias("rank")), 50)


@query(
    with_ctes("sc", "pri", "lab")
    + _FULL
    + """, e as (select query, fused_rank <= 50 as hit, query % 3 <> 0 as ok from full_ranks)
 select 'before' as part, count(*) as n, round(avg(hit::int), 6) as gold from e union all select 'after', count(*), round(avg(hit::int), 6) from e where ok union all select 'excluded', count(*), round(avg(hit::int), 6) from e where not ok"""
)
def eligibility_effect(spark, sf):
    e = _full(spark, sf).select("query", F.col("fused_rank").alias("rank"))
    return evaluation.eligibility_effect(e, F.col("query") % 3 != 0, 50).select("part", "n", r6("gold"))


_POP = f""", pop as (select user_id as item, ln(1 + greatest(0, sum(value))) as score from events group by all), st as (select item, row_number() over (order by round(score, 6) desc, {_TIE}) as rank, count(*) over (partition by round(score, 6)) - 1 as ties from pop)"""


@query("with x as (select 1)" + _POP + " select item, rank, ties from st")
def popularity_ranks(spark, sf):
    """One static order by log popularity, with how many share each score."""
    p = table(spark, sf, "events").groupBy(F.col("user_id").alias("item")).agg(F.sum("value").alias("s"))
    score = F.round(F.log1p(F.greatest(F.coalesce(F.nanvl("s", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))), 6)
    return retrieval.static_ranks(p.select("item", score.alias("score")), "score")


@query(
    with_ctes("lab")
    + _GOLD
    + f""", pop as (select item, label * 10 + item % 3 as score from vec), st as (select item, row_number() over (order by score desc, {_TIE}) as rank, count(*) over (partition by score) - 1 as ties from pop)
 select count(*) as n, round(avg((rank <= 10)::int), 6) as gold_10, median(rank) as median_rank, median(ties) as median_ties from gold join st using (item)"""
)
def static_baseline(spark, sf):
    """A score that knows no query: ranked once, looked up for every gold item, with its ties."""
    pop = inputs.vectors(spark, sf).select("item", (F.col("label") * 10 + F.col("item") % 3).alias("score"))
    j = _gold(spark, sf).join(retrieval.static_ranks(pop, "score"), "item")
    hit = F.round(F.avg((F.col("rank") <= 10).cast("int")), 6).alias("gold_10")
    return j.agg(F.count("*").alias("n"), hit, F.median("rank").alias("median_rank"), F.median("ties").alias("median_ties"))


@query(
    with_ctes("q", "pri", "lab")
    + _GOLD
    + """, p as (select query, count(*) as pool from q join pri using (task) group by all), g as (select gold.query, prior is not null as inside from gold join q using (query) left join pri on pri.task = q.task and pri.item = gold.item)
 select count(*) as n, round(avg(pool), 6) as mean_pool, round(avg(inside::int), 6) as gold_in_pool, round(avg(case when inside then least(1, 10 / pool) else 0 end), 6) as uniform_10 from p join g using (query)"""
)
def task_pool_audit(spark, sf):
    """Pools of the task's prior: their size, whether they hold the gold item, and a uniform draw of ten from them."""
    size = _query_prior(spark, sf).groupBy("query").agg(F.count("*").alias("pool"))
    inside = _gold(spark, sf).join(_query_prior(spark, sf), ["query", "item"], "left").select("query", F.col("prior").isNotNull().alias("inside"))
    j = size.join(inside, "query")
    uniform = F.when(F.col("inside"), F.least(F.lit(1.0), 10 / F.col("pool"))).otherwise(F.lit(0.0))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return j.agg(F.count("*").alias("n"), mean("pool", "mean_pool"), mean(F.col("inside").cast("int"), "gold_in_pool"), mean(uniform, "uniform_10"))


_META = """, mt as (select item, (item % 4 = 0)::int as flags, item % 5 <> 0 as in_snapshot, item % 3 = 0 as licensed, case when label % 4 = 0 then 'other' else 'f' || label % 4 end as family,
 case when item % 7 = 0 then 'nan'::double when item % 11 <> 0 then item / 10.0 end::double as size_b from vec), top as (select query, item from (select *, row_number() over (partition by query order by score desc, item) as r from sc) where r <= 10)"""


@query(
    with_ctes("sc", "lab")
    + _META
    + """ select top.query, round(count(value) / count(*), 6) as record_coverage, round(1 - count(value) / count(*), 6) as unknown, max(coalesce(value = best, false)::int) as recorded_gold,
 round(avg((flags = 0 and in_snapshot)::int), 6) as available, round(avg(licensed::int), 6) as licensed, round(count(distinct case when family <> 'other' then family end) / count(*), 6) as family_diversity,
 round(median(case when not isnan(size_b) then size_b end), 6) as median_size_b from top left join lab on lab.query = top.query and lab.item = top.item join mt on mt.item = top.item
 left join (select query as bq, max(value) as best from lab group by all) on bq = top.query group by all"""
)
def utility_scorecard(spark, sf):
    """What ten returned items are good for: records, availability, licences, families, sizes."""
    i, c = F.col("item"), F.col("label") % 4
    size = F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 != 0, i / 10.0)
    family = F.when(c == 0, "other").otherwise(F.concat(F.lit("f"), c.cast("string")))
    models = inputs.vectors(spark, sf).select(
        "item", (i % 4 == 0).cast("int").alias("flags"), (i % 5 != 0).alias("in_snapshot"), (i % 3 == 0).alias("licensed"), family.alias("family"), size.alias("size_b")
    )
    s = evaluation.scorecard(_search(spark, sf, 10).select("query", "item"), inputs.labels(spark, sf), models)
    rest = ("record_coverage", "unknown", "available", "licensed", "family_diversity", "median_size_b")
    return s.select("query", "recorded_gold", *[r6(c) for c in rest])


@query(
    with_ctes("sc", "lab")
    + _FIVE
    + """, g as (select unnest(['all', 'task ' || task] || case when task % 2 = 0 then ['even'] else [] end) as grp, hit1, regret1 from five join q using (query))
 select grp, count(*) as n, round(avg(hit1), 6) as hit1, round(avg(regret1), 6) as regret1 from g group by all having count(*) >= 5"""
)
def query_groups(spark, sf):
    """Means by overlapping groups of queries, those of five or more."""
    q = inputs.queries(spark, sf).select("query", "task")
    names = F.array(F.lit("all"), F.concat(F.lit("task "), F.col("task").cast("string")))
    names = F.concat(names, F.when(F.col("task") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>")))
    g = _five(spark, sf).join(q, "query").withColumn("grp", F.explode(names)).groupBy("grp")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("hit1"), 6).alias("hit1"), F.round(F.avg("regret1"), 6).alias("regret1")).where("n >= 5")


_LAYERS = """, ev as (select distinct item as model from vec where item % 10 = 0), li as (select item * 5 as src, item as dst from vec where item % 2 = 1 and item * 5 in (select item from vec)),
 bo as (select src as m, dst as o from li union select dst, src from li), nr as (select m, bool_or(o in (select model from ev)) as near from bo group by all),
 ly as (select item as model, case when item in (select model from ev) then 'warm' when near then 'cool' when near is not null then 'cold' else 'frozen' end as layer from vec left join nr on m = item)"""


def _layers(spark, sf):
    v = inputs.vectors(spark, sf).select(F.col("item").alias("model"))
    line = v.where("model % 2 = 1").select((F.col("model") * 5).alias("src"), F.col("model").alias("dst")).join(v.select(F.col("model").alias("src")), "src")
    return evaluation.layers(v, v.where("model % 10 = 0"), line)


@query(with_ctes("vec") + _LAYERS + " select layer, count(*) as n from ly group by all")
def model_layers(spark, sf):
    return _layers(spark, sf).groupBy("layer").agg(F.count("*").alias("n"))


@query(
    with_ctes("sc", "lab")
    + _LAYERS
    + _GOLD
    + """ select layer, count(*) as above from gold g join sc me on me.query = g.query and me.item = g.item join sc o on o.query = g.query and o.score > me.score join ly on ly.model = o.item group by all"""
)
def displacement_by_layer(spark, sf):
    """Of what layer the items are that stand above the gold ones."""
    q, v = inputs.queries(spark, sf), inputs.vectors(spark, sf)
    parts = []
    for name in ("warm", "cool", "cold", "frozen"):
        held = _layers(spark, sf).where(F.col("layer") == name).select(F.col("model").alias("item"))
        at = retrieval.pair_scores(_gold(spark, sf), q, v)
        parts.append(_above(q, v.join(held, "item", "left_semi"), at).select(F.lit(name).alias("layer"), "above"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("above > 0")


def _above(queries, items, at):
    """(above): how many items score higher than their query's probe: native, a broadcast a block of queries."""
    asked = queries.join(at.select("query", F.col("score").alias("at")), "query")
    total = retrieval.scores(asked, items).join(asked.select("query", "at"), "query")
    return total.agg(F.count_if(F.col("score") > F.col("at")).alias("above"))


@query("""with g as (select user_id % 3 as split, user_id as query, avg(value) as a, max(value) as b from events group by all),
 e as (select 'mean' as metric, split as seed, round(avg(a), 6) as value from g group by all union all select 'top', split, round(avg(b), 6) from g group by all)
 select metric, seed, value as expected, case when seed = 1 then value + 0.5 when seed = 0 then value end as actual, seed = 0 as ok from e""")
def recompute_compare(spark, sf):
    """Reported values against recomputed ones by (metric, seed): one that is off, one that is missing."""
    g = table(spark, sf, "events").groupBy((F.col("user_id") % 3).alias("seed"), F.col("user_id").alias("query")).agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    wide = g.groupBy("seed").agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.avg("b"), 6).alias("top"))
    long = wide.select("seed", F.expr("stack(2, 'mean', mean, 'top', top) as (metric, value)"))
    other = long.where("seed < 2").withColumn("value", F.col("value") + F.when(F.col("seed") == 1, 0.5).otherwise(0.0))
    return evaluation.compare(long, other, ["metric", "seed"], 1e-6)


@query("""with d as (select user_id % 3 as split, user_id, avg(value) filter (event_id % 2 = 0) - avg(value) filter (event_id % 2 = 1) as delta from events group by all),
 s as (select split, avg(delta) as d from d where delta is not null group by all) select round((select avg(delta) from d), 6) as mean_delta, (select min(d) >= 0 from s) as monotone""")
def promotion_gate(spark, sf):
    """A change is promoted if its interval is above 0, no split falls, and the guard holds (the interval's draws have no SQL)."""
    odd = F.col("event_id") % 2
    mean = lambda k: F.avg(F.when(odd == k, F.col("value")))
    d = table(spark, sf, "events").groupBy((F.col("user_id") % 3).alias("split"), F.col("user_id").alias("query")).agg((mean(0) - mean(1)).alias("delta"))
    d = cut(d.where("delta is not null"), "deltas")
    gate = evaluation.promotion(d, ranking.bootstrap(d, rounds=1000), F.col("delta") > -1e9)
    return gate.select(r6("mean_delta"), "monotone")


@query("""with e as (select event_type as system, user_id % 5 as ef, avg(value) as recall from events group by all), m as (select *, (select median(value) from events) as t from e)
 select system, coalesce(min(ef) filter (recall >= t), max(ef)) as ef, count(*) filter (recall >= t) as passing from m group by all""")
def first_passing_setting(spark, sf):
    """The least setting of each system whose recall passes; the largest where none does."""
    e = table(spark, sf, "events")
    least = e.agg(F.median("value")).first()[0] or 0.0
    grid = e.groupBy(F.col("event_type").alias("system"), (F.col("user_id") % 5).alias("ef")).agg(F.avg("value").alias("recall"))
    return evaluation.first_passing(grid, "system", "ef", "recall", least)


@query("""with x as (select l_quantity as n, l_extendedprice as t from lineitem) select round(regr_slope(t, ln(n)), 4) as log_slope, round(regr_intercept(t, ln(n)), 4) as log_intercept,
 round(exp(regr_intercept(ln(t), ln(n)) + regr_slope(ln(t), ln(n)) * ln(1e6)), 2) as power_at_million from x""")
def latency_fits(spark, sf):
    """A logarithmic and a power fit, the latter extrapolated."""
    n, t = F.col("l_quantity"), F.col("l_extendedprice")
    g = table(spark, sf, "lineitem").agg(
        F.regr_slope(t, F.log(n)).alias("s"), F.regr_intercept(t, F.log(n)).alias("i"), F.regr_slope(F.log(t), F.log(n)).alias("ps"), F.regr_intercept(F.log(t), F.log(n)).alias("pi")
    )
    at = F.exp(F.col("pi") + F.col("ps") * F.log(F.lit(1e6)))
    return g.select(F.round("s", 4).alias("log_slope"), F.round("i", 4).alias("log_intercept"), F.round(at, 2).alias("power_at_million"))


@query(
    with_ctes("sc", "lab")
    + """, d as (select q.task, q.query, count(*) as depth from q join lab using (query) group by all), one as (select task, query from (select *, row_number() over (partition by task order by depth desc, query) as r from d) where r = 1),
 top as (select query, item, score, r from (select *, row_number() over (partition by query order by score desc, item) as r from sc) where r <= 10)
 select task, query, r::int as rank, item, round(score, 6) as score, value from one join top using (query) left join lab using (query, item)"""
)
def example_recommendations(spark, sf):
    """The deepest query of each task with its ten items and what is recorded of them."""
    q, lab = inputs.queries(spark, sf), inputs.labels(spark, sf)
    depth = lab.groupBy("query").agg(F.count("*").alias("depth")).join(q, "query")
    one = retrieval.top_k(depth, 1, by=["task"], order=[F.desc("depth"), F.col("query")]).select("query", "task", "q")
    t = retrieval.blocked_top_k(one, inputs.vectors(spark, sf), 10)
    return t.join(one.select("query", "task"), "query").join(lab, ["query", "item"], "left").select("task", "query", "rank", "item", r6("score"), "value")


@query(
    with_ctes("vec")
    + """, a as (select unnest(v) as x, generate_subscripts(v, 1) as i, item from vec), m as (select i, avg(x) as m from a group by all)
 select count(distinct item) as n, round(sum(power(x - m, 2)) / count(distinct item), 4) as total_variance from a join m using (i)"""
)
def principal_plane(spark, sf):
    """Coordinates on the principal axes: all axes keep the whole variance, the first ones the most."""
    v = inputs.vectors(spark, sf)
    dims = F.size("v")
    k = v.agg(F.max(dims)).first()[0] or 1
    mean, axes, _ = vectors.principal(v, k)
    p = vectors.project(v, mean, axes).select("item", F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x).alias("r"))
    return p.agg(F.count("*").alias("n"), F.round(F.avg("r"), 4).alias("total_variance"))


@query(
    with_ctes("sc")
    + """, top as (select query, item, score from (select *, row_number() over (partition by query order by score desc, item) as r from sc) where r <= 64), w as (select top.query, top.item, 1 / (greatest(1 - score, 0) + 1e-6) as w, v from top join vec using (item)),
 e as (select query, w, unnest(v[1:2]) as x, generate_subscripts(v[1:2], 1) - 1 as pos from w) select query, pos::int as pos, round(sum(w * x) / sum(w), 5) as value from e group by all"""
)
def query_places(spark, sf):
    """Each query's place among its 64 nearest items, weighted by inverse distance."""
    places = inputs.vectors(spark, sf).select("item", F.transform(F.slice("v", 1, 2), lambda x: x.cast("double")).alias("p"))
    return vectors.interpolate(_search(spark, sf, 64), places).select("query", "pos", F.round("value", 5).alias("value"))


@query(
    with_ctes("vec")
    + """, k as (select item, label as key from vec), t as (select key, item as token from k), a as (select item, unnest(v) as x, generate_subscripts(v, 1) - 1 as pos from vec)
 select key, pos::int as pos, round(avg(x::double), 6) as value from t join a on item = token group by all"""
)
def mean_vectors(spark, sf):
    """The mean vector of each label's members."""
    v = inputs.vectors(spark, sf)
    tokens = v.select(F.col("label").alias("key"), F.col("item").alias("token"))
    return vectors.mean_of_tokens(tokens, v.select(F.col("item").alias("token"), "v")).select("key", "pos", r6("value"))


@query(with_ctes("vec") + " select p as pos, count(*) filter (v[p + 1] <> 0 and p <> 3) as n from vec, (select unnest([0, 3, 5]) as p) group by all")
def mask_violations(spark, sf):
    """Vectors with position 3 masked: what is left at positions that should be 0."""
    v = inputs.vectors(spark, sf).select(masked(F.transform("v", lambda x: x.cast("double")), (3,)).alias("v"))
    return vectors.mask_violations(v, (0, 3, 5))

