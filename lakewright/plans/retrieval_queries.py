"""Exact retrieval, reranking and list metrics over the embeddings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lakewright.functions.text import tie_key
from lakewright.functions.vector import dot, norm, unit
from lakewright.operators import ranking, retrieval, vectors
from lakewright.plans import inputs
from lakewright.plans.evidence_queries import r6
from lakewright.plans.inputs import with_ctes
from lakewright.storage import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _search(spark, sf, k):
    return retrieval.blocked_top_k(inputs.queries(spark, sf), inputs.vectors(spark, sf), k)


_TIE = "(item::hugeint * 11400714819323198485 + 15111065706836454659) % 18446744073709551616"


@query(with_ctes("sc") + " select query, item, rank::int as rank, round(score, 6) as score from (select *, row_number() over (partition by query order by score desc, item) as rank from sc) where rank <= 20")
def exact_top_k(spark, sf):
    return _search(spark, sf, 20).select("query", "item", "rank", r6("score"))


@query(with_ctes("sc") + " select query, item, rank::int as rank, round(score, 6) as score from (select *, row_number() over (partition by query order by score desc, item) as rank from sc) where rank <= 20")
def blocked_top_k(spark, sf):
    return retrieval.blocked_top_k(inputs.queries(spark, sf), inputs.vectors(spark, sf), 20).select("query", "item", "rank", r6("score"))


#: Candidates that are retrieved for a query before they are fused; the prefixes that are read of longer lists.
POOL, PREFIXES = 1000, (1000, 2000, 5000, 10_000)


@query(
    with_ctes("sc")
    + f""", d as (select *, row_number() over (partition by query order by score desc, item) as r from sc),
 k as (select unnest([{", ".join(map(str, PREFIXES))}]) as k)
 select query, k::int as k, count(*) as held, round(min(score), 6) as least from d, k where r <= k group by all"""
)
def nested_prefixes(spark, sf):
    """Nested pools of one search: how many rows each holds and its least score."""
    t = _search(spark, sf, max(PREFIXES))
    each = t.withColumn("k", F.explode(F.array(*map(F.lit, PREFIXES)))).where("rank <= k")
    return each.groupBy("query", "k").agg(F.count("*").alias("held"), F.round(F.min("score"), 6).alias("least"))


_POOL = f""", pool as (select query, item, score from (select *, row_number() over (partition by query order by score desc, item) as r
 from sc) where r <= {POOL})"""
_FUSED = (
    _POOL
    + f""", f as (select query, pool.item, score, ((score::float + 1::float) / 2::float)::float + coalesce(prior, 0)::float as fused
 from pool join q using (query) left join pri on pri.task = q.task and pri.item = pool.item),
 fr as (select *, row_number() over (partition by query order by fused desc, {_TIE}) as rank from f)"""
)


def _query_prior(spark, sf):
    """(query, item, prior): the priors of each query's task."""
    return inputs.queries(spark, sf).select("query", "task").join(inputs.priors(spark, sf), "task").drop("task")


def _fused(spark, sf, k):
    return retrieval.fuse(_search(spark, sf, POOL), _query_prior(spark, sf), ["query", "item"], k)


@query(with_ctes("sc", "pri") + _FUSED + " select query, item, rank::int as rank, round(fused::double, 5) as fused from fr where rank <= 10")
def fused_rerank(spark, sf):
    """A thousand candidates, reranked with the priors, first ten."""
    return _fused(spark, sf, 10).select("query", "item", "rank", F.round(F.col("fused").cast("double"), 5).alias("fused"))


@query(
    with_ctes("q", "pri")
    + f""", p as (select query, item, prior from (select query, item, prior, row_number() over (partition by query order by prior desc, {_TIE}) as r
 from q join pri using (task)) where r <= 10),
 u as (select item from vec order by {_TIE}, item limit 20),
 z as (select query, item, 0.0::double as prior from q, u where (query, item) not in (select query, item from p))
 select query, item, rank::int as rank, prior from (select *, row_number() over (partition by query order by prior desc, {_TIE}) as rank
 from (select * from p union all select * from z)) where rank <= 10"""
)
def prior_with_backfill(spark, sf):
    """The task's items by prior alone, over all items; where there are too few, items of no prior in tie order."""
    best = retrieval.top_k(_query_prior(spark, sf), 10, order=[F.desc("prior"), tie_key(F.col("item"))])
    return retrieval.backfill(best, inputs.vectors(spark, sf), inputs.queries(spark, sf)).select("query", "item", "rank", "prior")


_RANKS = """, pb as (select *, row_number() over (partition by query order by value desc, item) as r, value >= max(value) over (partition by query) - 0.01 as near from lab),
 rk as (select pb.query, pb.item, pb.value, pb.r, pb.near, count(*) filter (o.score > s.score) + 1 as rank from pb join sc s on pb.query = s.query and pb.item = s.item join sc o on o.query = pb.query where pb.r <= 3 or near group by all),
 qr as (select query, min(rank) filter (r = 1) as gold_rank, min(rank) filter (r <= 3) as top3_rank, min(rank) filter (near) as gap_rank from rk group by all)"""


def _ranks(spark, sf):
    p = ranking.probes(inputs.labels(spark, sf)).where("top3 or near")
    ranks = retrieval.full_ranks(inputs.queries(spark, sf), inputs.vectors(spark, sf), p)
    return ranking.query_ranks(p.join(ranks, ["query", "item"])).drop("n_candidates")


@query(with_ctes("sc", "lab") + _RANKS + " select * from qr")
def gold_ranks(spark, sf):
    return _ranks(spark, sf)


@query(with_ctes("sc", "lab") + _RANKS + """ select count(*) as n, round(avg((gold_rank <= 10)::int), 6) as gold_10, round(avg((gold_rank <= 100)::int), 6) as gold_100, round(avg((gap_rank <= 10)::int), 6) as gap_10,
 round(avg((top3_rank <= 10)::int), 6) as top3_10, median(gold_rank) as median_rank, round(avg(1.0 / gold_rank), 6) as mrr from qr""")
def gold_at_k(spark, sf):
    r = _ranks(spark, sf)
    return r.agg(F.count("*").alias("n"), F.round(F.avg(ranking.hit(F.col("gold_rank"), 10)), 6).alias("gold_10"), F.round(F.avg(ranking.hit(F.col("gold_rank"), 100)), 6).alias("gold_100"), F.round(F.avg(ranking.hit(F.col("gap_rank"), 10)), 6).alias("gap_10"), F.round(F.avg(ranking.hit(F.col("top3_rank"), 10)), 6).alias("top3_10"), F.median("gold_rank").alias("median_rank"), F.round(F.avg(1 / F.col("gold_rank")), 6).alias("mrr"))


@query(with_ctes("sc", "lab") + _RANKS + ", m as (select task, avg((gold_rank <= 50)::int) as m from qr join q using (query) group by all) select (select round(avg((gold_rank <= 50)::int), 6) from qr) as micro, round(avg(m), 6) as macro from m")
def micro_and_macro(spark, sf):
    r = _ranks(spark, sf).join(inputs.queries(spark, sf).select("query", "task"), "query").withColumn("hit", ranking.hit(F.col("gold_rank"), 50))
    return ranking.macro(r, "task", "hit").select(r6("micro"), r6("macro"))


_SL = ", sl as (select lab.query, lab.item, value, score from lab join sc on lab.query = sc.query and lab.item = sc.item)"


def _labelled(spark, sf):
    return retrieval.pair_scores(inputs.labels(spark, sf), inputs.queries(spark, sf), inputs.vectors(spark, sf))


@query(with_ctes("sc", "lab") + _SL + """, g as (select query, coalesce((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0), 1) as g, row_number() over (w order by score desc, item) as r, row_number() over (w order by value desc, item) as i from sl window w as (partition by query))
 select query, round(sum(case when r <= 10 then g / log2(r + 1) else 0 end) / sum(case when i <= 10 then g / log2(i + 1) else 0 end), 6) as ndcg from g group by all""")
def labelled_ndcg(spark, sf):
    return ranking.ndcg(_labelled(spark, sf)).select("query", r6("ndcg"))


@query(with_ctes("sc", "lab") + _SL + """, p as (select a.query, sign(a.score - b.score) as x, sign(a.value - b.value) as y from sl a join sl b on a.query = b.query and a.item < b.item)
 select query, round(sum(x * y) / nullif(sqrt(sum(abs(x))::double * sum(abs(y))), 0), 6) as tau from p group by all""")
def kendall_tau(spark, sf):
    return ranking.kendall(_labelled(spark, sf)).select("query", r6("tau"))


@query(with_ctes("sc", "lab") + _SL + """, r as (select query, rank() over (partition by query order by score) + (count(*) over (partition by query, score) - 1) / 2.0 as a, rank() over (partition by query order by value) + (count(*) over (partition by query, value) - 1) / 2.0 as b from sl)
 select query, round(corr(a::double, b::double), 6) as rho from r group by all""")
def spearman_rho(spark, sf):
    return ranking.spearman(_labelled(spark, sf)).select("query", r6("rho"))


@query(with_ctes("sc", "lab") + _SL + """ select query, arg_max(item, (score, -item)) as selected, round(max(value) - arg_max(value, (score, -item)), 6) as regret, (arg_max(value, (score, -item)) = max(value))::int as hit1 from sl group by all""")
def observed_top1(spark, sf):
    pick = F.struct("score", (-F.col("item")).alias("i"))
    g = _labelled(spark, sf).groupBy("query").agg(F.max_by(F.struct("item", "value"), pick).alias("s"), F.max("value").alias("best"))
    return g.select("query", F.col("s.item").alias("selected"), F.round(F.col("best") - F.col("s.value"), 6).alias("regret"), (F.col("s.value") == F.col("best")).cast("int").alias("hit1"))


@query(with_ctes("sc", "lab") + _SL + """, p as (select least(1, greatest(0, (score + 1) / 2)) as p, value as y from sl), b as (select least(floor(p * 10), 9)::int as bin, count(*) as n, avg(p) as mp, avg(y) as my from p group by all)
 select bin, n, round(mp, 6) as mean_p, round(my, 6) as mean_y, round(abs(mp - my) * n / sum(n) over (), 6) as gap_share from b""")
def calibration_bins(spark, sf):
    p = _labelled(spark, sf).select(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") + 1) / 2)).alias("p"), F.col("value").alias("y"))
    return ranking.calibration(p).select("bin", "n", r6("mean_p"), r6("mean_y"), r6("gap_share"))


_TOP = ", top as (select query, item, r from (select *, row_number() over (partition by query order by score desc, item) as r from sc) where r <= 10)"


def _top10(spark, sf):
    return _search(spark, sf, 10)


@query(with_ctes("sc", "lab") + _TOP + """ select top.query, count(value) as verified, round(count(value) / 10.0, 6) as coverage, round(sum(coalesce(value / m, 0)) / 10, 6) as utility_bound, count(*) filter (value >= m - 0.01) as near_best from top left join lab on lab.query = top.query and lab.item = top.item
 join (select query, max(value) as m from lab group by all) b on b.query = top.query group by all""")
def verified_lists(spark, sf):
    lab = inputs.labels(spark, sf)
    j = _top10(spark, sf).join(lab, ["query", "item"], "left").join(lab.groupBy("query").agg(F.max("value").alias("m")), "query")
    return j.groupBy("query").agg(F.count("value").alias("verified"), F.round(F.count("value") / 10.0, 6).alias("coverage"), F.round(F.sum(F.coalesce(F.col("value") / F.col("m"), F.lit(0.0))) / 10, 6).alias("utility_bound"), F.count_if(F.col("value") >= F.col("m") - 0.01).alias("near_best"))


@query(with_ctes("sc") + _TOP + """ select top.query, count(*) filter (label = task) as same_task, count(*) filter (label <> task) as off_task, (count(*) filter (label = task) >= 8)::int as task_pure from top join vec using (item) join q on q.query = top.query group by all""")
def task_purity(spark, sf):
    j = _top10(spark, sf).join(inputs.vectors(spark, sf).select("item", "label"), "item").join(inputs.queries(spark, sf).select("query", "task"), "query")
    same = F.count_if(F.col("label") == F.col("task"))
    return j.groupBy("query").agg(same.alias("same_task"), F.count_if(F.col("label") != F.col("task")).alias("off_task"), (same >= 8).cast("int").alias("task_pure"))


@query(with_ctes("sc") + _TOP + """, l as (select query, task as signature, list(item order by item) as items from top join q using (query) group by all),
 j as (select avg(len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))) as j from l a join l b on a.signature = b.signature and a.query < b.query)
 select round((select count(distinct item) from top) / (select count(*) from vec), 6) as catalog_coverage, round((select count(distinct items) / count(*) from l), 6) as unique_share, round((select j from j), 6) as mean_jaccard""")
def list_specificity(spark, sf):
    lists = _top10(spark, sf).join(inputs.queries(spark, sf).select("query", F.col("task").alias("signature")), "query").select("query", "signature", "item")
    s = ranking.specificity(lists, inputs.vectors(spark, sf).count())
    return s.select(r6("catalog_coverage"), r6("unique_share"), r6("mean_jaccard"))


@query(with_ctes("sc", "lab") + _RANKS + """, a as (select query, gold_rank <= 50 as x, gap_rank <= 20 as y from qr) select count(*) filter (x and y) as both_hit, count(*) filter (x and not y) as rescue, count(*) filter (not x and y) as harm, count(*) filter (not x and not y) as neither from a""")
def system_quadrants(spark, sf):
    x, y = F.col("gold_rank") <= 50, F.col("gap_rank") <= 20
    return _ranks(spark, sf).agg(F.count_if(x & y).alias("both_hit"), F.count_if(x & ~y).alias("rescue"), F.count_if(~x & y).alias("harm"), F.count_if(~x & ~y).alias("neither"))


@query(with_ctes("sc") + """, nr as (select item, avg(score) as r from (select *, row_number() over (partition by item order by score desc, query) as k from sc) where k <= 5 group by all), c as (select query, item, 2 * score - r as score from sc join nr using (item))
 select query, item, rank::int as rank, round(score, 6) as score from (select *, row_number() over (partition by query order by round(score, 9) desc, item) as rank from c) where rank <= 10""")
def hub_corrected(spark, sf):
    c = retrieval.blocked_csls(inputs.queries(spark, sf), inputs.vectors(spark, sf), 5, 10)
    return c.select("query", "item", "rank", r6("score"))


@query(with_ctes("sc") + _TOP + """, h as (select query, list(item) as a from top where r <= 10 group by all), b as (select query, list(item) as b from (select *, row_number() over (partition by query order by round(score, 2) desc, item) as r from sc) where r <= 10 group by all)
 select query, round(len(list_intersect(a, b)) / 10.0, 6) as recall from h join b using (query)""")
def recall_of_rounded(spark, sf):
    """Overlap of the exact lists with those of scores rounded to two digits."""
    q, v = inputs.queries(spark, sf), inputs.vectors(spark, sf)
    exact, rough = retrieval.blocked_top_k(q, v, 10), retrieval.blocked_top_k(q, v, 10, digits=2)
    both = exact.select("query", "item").join(rough.select("query", "item"), ["query", "item"]).groupBy("query").agg(F.count("*").alias("k"))
    return q.select("query").distinct().join(both, "query", "left").select("query", F.round(F.coalesce("k", F.lit(0)) / 10.0, 6).alias("recall"))


@query(with_ctes("vec") + """, u as (select item, unnest(v) / sqrt(list_dot_product(v, v)) as x, generate_subscripts(v, 1) as i from vec), s as (select i, sum(x) as s, count(*) as n from u group by all)
 select max(n)::bigint as n, round((sum(s * s) - max(n)) / (max(n)::double * (max(n) - 1)), 6) as mean_cosine from s""")
def embedding_geometry(spark, sf):
    """Mean cosine over all pairs by the squared length of the sum: no pair is made."""
    u = inputs.vectors(spark, sf).select(F.posexplode(unit(F.col("v"), 0.0)).alias("i", "x"))
    s = u.groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return s.agg(F.max("n").alias("n"), F.round((F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n").cast("double") * (F.max("n") - 1)), 6).alias("mean_cosine"))


@query(with_ctes("vec") + """, a as (select label, unnest(v) as x, generate_subscripts(v, 1) as i from vec), c as (select label, i, avg(x) as m from a group by all), d as (select v.item, v.label, list(m order by i) as c from vec v join c on v.label = c.label group by all)
 select d.label, count(*) as n, round(avg(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c))), 6) as centroid_cosine from d join vec using (item) group by all""")
def centroid_cosine(spark, sf):
    v = inputs.vectors(spark, sf)
    c = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", F.col("c.m").alias("c"))
    return v.join(c, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(dot(F.col("v"), F.col("c")) / (norm(F.col("v")) * norm(F.col("c")))), 6).alias("centroid_cosine"))


@query(with_ctes("vec") + """, a as (select item, unnest(v) as x, generate_subscripts(v, 1) as i from vec), m as (select i, avg(x) as m from a group by all),
 z as (select item, i, x - m as x from a join m using (i)), c as (select a.i, b.i as j, avg(a.x * b.x) as c from z a join z b using (item) group by all)
 select round(pow(sum(c) filter (i = j), 2) / sum(c * c), 4) as participation_ratio from c""")
def participation_ratio(spark, sf):
    """Effective dimensions as trace(C)^2 / trace(C^2) of the covariance, from one small sum of products a task."""
    return vectors.participation(inputs.vectors(spark, sf).select("v")).select(F.round("participation_ratio", 4).alias("participation_ratio"))


@query(with_ctes("lab") + """, n as (select query, count(*) as n, max(value) as m, avg(value) as a, count(*) filter (value >= mx - 0.01) as near, count(*) filter (value = mx) as best from (select *, max(value) over (partition by query) as mx from lab) group by all)
 select round(avg(best / n), 6) as hit1, round(avg(least(3, n) / n), 6) as top3, round(avg(m - a), 6) as regret, round(avg(1 - list_reduce(list_prepend(1.0::double, list_transform(range(10), lambda j: greatest(pool - near - j, 0) / (pool - j)::double)), lambda x, y: x * y)), 6) as gap_10 from n, (select count(*) as pool from embeddings)""")
def random_baseline(spark, sf):
    w = Window.partitionBy("query")
    n = inputs.labels(spark, sf).withColumn("mx", F.max("value").over(w)).groupBy("query").agg(F.count("*").alias("n"), F.max("value").alias("m"), F.avg("value").alias("a"), F.count_if(F.col("value") >= F.col("mx") - 0.01).alias("near"), F.count_if(F.col("value") == F.col("mx")).alias("best"))
    n = n.crossJoin(inputs.vectors(spark, sf).agg(F.count("*").alias("pool")))
    return n.agg(F.round(F.avg(F.col("best") / F.col("n")), 6).alias("hit1"), F.round(F.avg(F.least(F.lit(3), F.col("n")) / F.col("n")), 6).alias("top3"), F.round(F.avg(F.col("m") - F.col("a")), 6).alias("regret"), F.round(F.avg(ranking.random_hits(F.col("pool"), F.col("near"), 10)), 6).alias("gap_10"))


@query(None)
def bootstrap_interval(spark, sf):
    """Paired bootstrap of hashed draws: the draws are this module's own, so SQL elsewhere can't repeat them."""
    d = _ranks(spark, sf).select("query", (ranking.hit(F.col("gold_rank"), 50) - ranking.hit(F.col("gap_rank"), 20)).alias("delta"))
    b = ranking.bootstrap(d)
    return b.select("n_paired", r6("mean_delta"), r6("ci_low"), r6("ci_high"), r6("prob_positive"))


@query("select round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) as slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) as intercept from lineitem")
def power_fit(spark, sf):
    li = table(spark, sf, "lineitem")
    x, y = F.log("l_quantity"), F.log("l_extendedprice")
    return li.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by all")
def latency_percentiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("""with s as (select user_id % 3 as seed, event_type, avg(value) as a, count(*) filter (value > 50) as hi, count(*) as n from events group by all) select event_type, round(avg(a), 6) as mean, round(min(a), 6) as lo, round(max(a), 6) as hi, round(avg(hi::double / nullif(n, 0)), 6) as mean_ratio from s group by all""")
def cross_seed_summary(spark, sf):
    """Means over seeds; the mean of the seeds' ratios, never the ratio of means."""
    s = table(spark, sf, "events").groupBy((F.col("user_id") % 3).alias("seed"), "event_type").agg(F.avg("value").alias("a"), F.count_if(F.col("value") > 50).alias("h"), F.count("*").alias("n"))
    return s.groupBy("event_type").agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.min("a"), 6).alias("lo"), F.round(F.max("a"), 6).alias("hi"), F.round(F.avg(F.try_divide("h", "n")), 6).alias("mean_ratio"))
