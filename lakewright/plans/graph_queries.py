"""Graph operators over orders (customer - nation - part) and similarity edges of the embeddings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lakewright.operators import components, graph, retrieval
from lakewright.plans import inputs
from lakewright.plans.evidence_queries import r6
from lakewright.plans.inputs import with_ctes
from lakewright.storage import cut, table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_KNN = (
    with_ctes("vec")
    + """, ks as (select a.item as src, b.item as dst, round(list_dot_product(a.v, b.v), 9) as w from vec a, vec b where a.item <> b.item),
 knn as materialized (select src, dst, w from (select *, row_number() over (partition by src order by w desc, dst) as r from ks) where r <= 5)"""
)


def _knn(spark, sf):
    """Similarity edges of every vector: src, dst, w, by blocks of vectors against all."""
    v = inputs.vectors(spark, sf)
    every = v.select(F.col("item").alias("query"), F.col("v").alias("q"))
    found = retrieval.blocked_top_k(every, v, 5, skip_self=True)
    return cut(found.select(F.col("query").alias("src"), F.col("item").alias("dst"), F.col("score").alias("w")), "knn")


def _supply(spark, sf):
    """Supplier - part edges with the mean price."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.avg("l_extendedprice").alias("w"))


_SUP = "with sup as (select l_suppkey as src, l_partkey as dst, avg(l_extendedprice) as w from lineitem group by all)"


@query(_KNN + " select src, dst, round(w, 6) as w from knn")
def knn_edges(spark, sf):
    return _knn(spark, sf).select("src", "dst", r6("w"))


@query(_SUP + " select 'supplies' as relation, count(*) as n, count(distinct src) as sources from sup union all select 'rev_supplies', count(*), count(distinct dst) from sup")
def relation_counts(spark, sf):
    e = _supply(spark, sf)
    side = lambda d, name: d.agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources")).select(F.lit(name).alias("relation"), "n", "sources")
    return side(e, "supplies").unionByName(side(graph.reverse(e), "rev_supplies"))


@query("select o_custkey as src, count(*) as degree from orders group by all")
def degrees(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("src")).agg(F.count("*").alias("degree"))


@query("""with n as (select o_custkey, count(*) as n from orders group by all), l as (select list_sort(list(n)) as c from n) select len(c)::bigint as parents, c[-1] as most, 0::bigint as over_1000,
 c[floor(0.5 * (len(c) - 1))::int + 1] as p50, c[floor(0.9 * (len(c) - 1))::int + 1] as p90, c[floor(0.99 * (len(c) - 1))::int + 1] as p99 from l""")
def hub_statistics(spark, sf):
    return graph.hub_stats(table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


@query(_SUP + """, d as (select src, count(*) as d from sup group by all), c as (select ceil(quantile_cont(d, 0.5)) as cap from d)
 select src, count(*) as kept, round(min(w), 4) as least from (select *, row_number() over (partition by src order by w desc, dst) as r from sup), c where r <= cap group by all""")
def degree_cap(spark, sf):
    return graph.degree_cap(_supply(spark, sf), 0.5).groupBy("src").agg(F.count("*").alias("kept"), F.round(F.min("w"), 4).alias("least"))


@query(_KNN + """, b as (select src, dst, max(w) as w from (select src, dst, w from knn union all select dst, src, w from knn) group by all) select src, dst, rank::int as rank from (select *, row_number() over (partition by src order by round(w, 9) desc, dst) as rank from b) where rank <= 3""")
def symmetric_top_k(spark, sf):
    k = _knn(spark, sf).withColumn("w", F.round("w", 9))
    return graph.symmetric_top(k, 3).select("src", "dst", "rank")


@query("""with o as (select o_orderkey * 2 + 1 as a, o_custkey * 2 as b from orders), n as (select (o_orderkey + 5) * 2 + 1 as a, o_custkey * 2 as b from orders),
 e as (select a, b from o union select a, b from n), ends as (select a as node from e union select b from e),
 orders_of as (select a, min(b) as c from e group by a), s0 as (select b, min(c) as c from e join orders_of using (a) group by b),
 s1 as (select a, min(c) as c from e join s0 using (b) group by a), s2 as (select b, min(c) as c from e join s1 using (a) group by b),
 s3 as (select a, min(c) as c from e join s2 using (b) group by a), s4 as (select b, min(c) as c from e join s3 using (a) group by b),
 s5 as (select a, min(c) as c from e join s4 using (b) group by a), s6 as (select b, min(c) as c from e join s5 using (a) group by b),
 s7 as (select a, min(c) as c from e join s6 using (b) group by a), s8 as (select b, min(c) as c from e join s7 using (a) group by b),
 s9 as (select a, min(c) as c from e join s8 using (b) group by a), t0 as (select b, min(c) as c from e join s9 using (a) group by b),
 t1 as (select a, min(c) as c from e join t0 using (b) group by a), t2 as (select b, min(c) as c from e join t1 using (a) group by b),
 t3 as (select a, min(c) as c from e join t2 using (b) group by a), t4 as (select b, min(c) as c from e join t3 using (a) group by b)
 select (select count(*) from ends) as nodes, (select count(distinct c) from t4) as components""")
def component_count(spark, sf):
    """Customers tied by orders that follow one another: nodes and components over all orders."""
    o = table(spark, sf, "orders")
    customer = (F.col("o_custkey") * 2).alias("src")
    one = o.select(customer, (F.col("o_orderkey") * 2 + 1).alias("dst"))
    two = o.select(customer, ((F.col("o_orderkey") + 5) * 2 + 1).alias("dst"))
    made = components.connected_components(one.union(two))
    return made.agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))


@query(
    _KNN
    + """, h1 as (select src as seed, dst as node from knn), h2 as (select h1.seed, k.dst as node from h1 join knn k on k.src = h1.node)
 select seed, node, min(hop)::int as hop from (select item as seed, item as node, 0 as hop from vec union all select seed, node, 1 from h1
 union all select seed, node, 2 from h2) group by all"""
)
def hop_closure(spark, sf):
    """All nodes within two hops of each vector."""
    seeds = inputs.vectors(spark, sf).select(F.col("item").alias("seed"), F.col("item").alias("node"))
    return graph.closure(seeds, _knn(spark, sf), 2)


@query(
    _SUP
    + """, c as (select src, dst from (select *, row_number() over (partition by src order by md5(concat_ws(':', src::varchar, dst::varchar)), dst) as r
 from sup) where r <= 3) select seed, node, min(hop)::int as hop from (select distinct src as seed, -src as node, 0 as hop from sup
 union all select src, dst, 1 from c) group by all"""
)
def fan_out_sample(spark, sf):
    """Each supplier and three of its parts by a hash order; suppliers as negative nodes."""
    e = _supply(spark, sf).withColumn("src", -F.col("src"))
    seeds = e.select((-F.col("src")).alias("seed"), F.col("src").alias("node")).distinct()
    hashed = F.md5(F.concat_ws(":", (-F.col("src")).cast("string"), F.col("dst").cast("string")))
    return graph.closure(seeds, e, 1, fan_out=3, order=hashed)


@query(
    _KNN
    + """, a as (select item, unnest(v) as x, generate_subscripts(v, 1) - 1 as pos from vec)
 select src, pos::int as pos, round(sum(w * x) / sum(w), 6) as value from knn join a on dst = item group by all"""
)
def neighbour_mean(spark, sf):
    """The weighted mean of each vector's neighbours, all dimensions."""
    return graph.neighbour_mean(_knn(spark, sf), inputs.vectors(spark, sf)).select("src", "pos", r6("value"))


_POSITIVE = """, tf as (select *, row_number() over (partition by dst order by w desc, src) as k, count(*) over (partition by dst) as n from sup),
 pos as (select src, dst from tf where k <= greatest(1, round_even(0.1 * n, 0)))"""


@query(
    _SUP
    + _POSITIVE
    + """, q as (select *, quantile_cont(w, 0.3) over (partition by dst) as q, count(*) over (partition by dst) as n from sup)
 select src, count(*) as low from q where w <= q and n >= 3 and (src, dst) not in (select src, dst from pos) group by all"""
)
def known_low_negatives(spark, sf):
    return graph.known_low(_supply(spark, sf)).groupBy("src").agg(F.count("*").alias("low"))


@query(
    _SUP
    + """, t as (select p_partkey as dst, p_size % 4 as task from part), h as (select distinct src, task from sup join t using (dst)),
 m as (select count(distinct src) as n from sup) select dst, n - (select count(*) from h where h.task = t.task) as n
 from (select distinct dst from sup) join t using (dst), m where task <> 0"""
)
def incompatible_negatives(spark, sf):
    """How many suppliers have no part of the part's class; class 0 is other."""
    tasks = table(spark, sf, "part").select(F.col("p_partkey").alias("dst"), (F.col("p_size") % 4).alias("task"))
    return graph.incompatible(_supply(spark, sf), tasks)


_MASS = (
    _SUP
    + """, m as (select c_custkey as src from customer), d as (select m.src, count(sup.src) as degree from m left join sup on sup.src = m.src group by all),
 p as (select *, pow(degree + 1, 0.75) as w from d),
 q as (select src, degree, 0.9 * w / sum(w) over () + case when degree > 0 then 0.1 / count(*) filter (degree > 0) over () else 0 end as q from p)"""
)


def _mass(spark, sf):
    models = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"))
    return graph.sampling_mass(_supply(spark, sf).join(models, "src", "left_semi"), models, gamma=0.1)


@query(_MASS + " select src, degree, round(q, 9) as q from q")
def sampling_mass(spark, sf):
    """Customers as models: those without an edge have mass too, but no part of the uniform share."""
    return _mass(spark, sf).select("src", "degree", F.round("q", 9).alias("q"))


@query(_MASS + " select degree > 0 as labelled, count(*) as n, round(sum(q), 6) as mass, round(sum(1 - pow(1 - q, 1000)), 4) as touched from q group by all")
def sampling_audit(spark, sf):
    """Mass of labelled and other models, and how many a thousand draws are expected to touch."""
    touched = F.sum(1 - F.pow(1 - F.col("q"), F.lit(1000)))
    g = _mass(spark, sf).groupBy((F.col("degree") > 0).alias("labelled"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("q"), 6).alias("mass"), F.round(touched, 4).alias("touched"))


@query(_SUP + ", t as (select src, list(distinct p_size order by p_size) as sizes from sup join part on dst = p_partkey group by all) select src, len(sizes)::bigint as n, sizes[1] as first from t")
def task_profiles(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("dst"), "p_size")
    s = F.array_sort(F.collect_set("p_size"))
    return _supply(spark, sf).join(p, "dst").groupBy("src").agg(s.alias("s")).select("src", F.size("s").cast("long").alias("n"), F.element_at("s", 1).alias("first"))


@query(_SUP + ", r as (select distinct src, p_brand from sup join part on dst = p_partkey) select src, count(*) as pooled from r join part using (p_brand) group by all")
def positives_by_root(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("dst"), "p_brand")
    roots = _supply(spark, sf).join(p, "dst").select("src", "p_brand").distinct()
    return roots.join(p.groupBy("p_brand").agg(F.count("*").alias("k")), "p_brand").groupBy("src").agg(F.sum("k").alias("pooled"))


@query("""with e as (select l_partkey % 50 as d, l_suppkey as m, round(avg(l_extendedprice) * 1000)::bigint as w from lineitem group by all) select a.d, count(*) as pairs from e a join e b on a.d = b.d and a.w - b.w > 20000000 group by all""")
def contrast_pairs(spark, sf):
    """Pairs of a dataset where one is better by a gap."""
    e = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("d"), F.col("l_suppkey").alias("m"))
    return graph.gap_pairs(e.agg(graph.rounded_mean(F.col("l_extendedprice"), 1000).alias("w")), 20_000_000)


@query("with e as (select distinct l_suppkey as m, l_partkey % 50 as d from lineitem) select a.m, count(distinct b.m) as peers from e a join e b on a.d = b.d and a.m <> b.m group by all")
def co_members(spark, sf):
    return graph.peers(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("m"), (F.col("l_partkey") % 50).alias("d")))


@query(_SUP + ", r as (select *, row_number() over (partition by dst order by w desc, src) as k, count(*) over (partition by dst) as n from sup) select dst, count(*) as kept from r where k <= greatest(1, round_even(0.1 * n, 0)) group by all")
def top_fraction(spark, sf):
    by = Window.partitionBy("dst")
    r = _supply(spark, sf).withColumn("k", F.row_number().over(by.orderBy(F.desc("w"), "src"))).withColumn("n", F.count("*").over(by))
    return r.where(F.col("k") <= F.greatest(F.lit(1.0), F.bround(0.1 * F.col("n"), 0))).groupBy("dst").agg(F.count("*").alias("kept"))
