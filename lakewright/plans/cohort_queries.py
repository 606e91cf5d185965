"""Card matching, cold-start strata, repairs, leave-out variants, payload checks and forecasts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions.vector import block, joined
from lakewright.operators import cohorts, vectors
from lakewright.plans import inputs
from lakewright.plans.audit_queries import _SIDES, _roles
from lakewright.plans.evaluation_queries import _LAYERS, _layers
from lakewright.plans.evidence_queries import _SPLIT, _split, r6
from lakewright.plans.graph_queries import _SUP, _supply
from lakewright.plans.inputs import with_ctes
from lakewright.plans.retrieval_queries import _SL, _labelled
from lakewright.storage import cut, table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_CARD_ID = "case when p_partkey % 4 = 0 then 'org' || (p_partkey % 7) || '/set' || (p_partkey % 23) else 'set' || (p_partkey % 37) end"
_NODE = """case o_orderkey % 5 when 0 then 'set' || (o_orderkey % 60) when 1 then 'org' || (o_orderkey % 9) || '/set' || (o_orderkey % 30)
 when 2 then 'set' || (o_orderkey % 40) || '/sub' || (o_orderkey % 3) when 3 then ' ORG' || (o_orderkey % 9) || '/Set' || (o_orderkey % 30) else 'no' || o_orderkey end"""


@query(
    f"""with c as (select distinct {_CARD_ID} as id from part), l as (select split_part(id, '/', -1) as b, count(*) as n, min(id) as one from c group by all),
 nd as (select {_NODE} as dataset, lower(trim({_NODE})) as d from orders), p as (select *, contains(d, '/') as owned, split_part(d, '/', -1) as b,
 case when contains(d, '/') then split_part(d, '/', 1) end as parent from nd),
 j as (select p.*, e.id as e, l.n, l.one, coalesce(pe.id, case when pl.n = 1 then pl.one end) as via from p left join c e on e.id = d left join l on l.b = p.b
 left join c pe on pe.id = parent left join l pl on pl.b = parent),
 r as (select case when e is not null then 'hf_card' when owned then case when via is not null then 'hf_card_via_parent' when n > 0 then 'name_only_cross_owner_rejected' else 'name_only' end
 when n = 1 then 'hf_card' when n > 1 then 'name_only_ambiguous' else 'name_only' end as card_source,
 case when e is not null then d when owned then via when n = 1 then one end as matched_id from j)
 select card_source, matched_id, count(*) as n from r group by all"""
)
def card_sources(spark, sf):
    """How each dataset node comes by a card: id, unique last part, parent, rejected, ambiguous or none."""
    cards = table(spark, sf, "part").select(F.expr(_CARD_ID).alias("id")).distinct()
    nodes = table(spark, sf, "orders").select(F.expr(_NODE).alias("dataset"))
    return cohorts.match_cards(nodes, cards).groupBy("card_source", "matched_id").agg(F.count("*").alias("n"))


_COLD = (
    with_ctes("edges")
    + _SPLIT
    + """, vis as (select model as item, dataset, task from edges join split on dataset = root where side <> 'test'),
 gold as (select dataset, task, arg_max(model, (weight, -model)) as item from edges join split on dataset = root where side = 'test' group by all),
 deg as (select item, count(distinct dataset) as degree from vis group by all), peers as (select task, count(distinct dataset) as peers from vis group by all),
 g as (select gold.*, coalesce(degree, 0) as degree, coalesce(peers, 0) as peers, (select count(*) from deg d where d.degree > coalesce(deg.degree, 0)) + 1 as rank
 from gold left join deg using (item) left join peers using (task)),
 b as (select 'gold_degree' as dimension, case when degree <= 2 then 'cold (<=2)' when degree <= 10 then 'mid (3-10)' else 'warm (>=11)' end as stratum, rank from g
 union all select 'task_peers', case when peers <= 5 then 'rare task (<=5)' when peers <= 50 then 'mid (6-50)' else 'common task (>=51)' end, rank from g)"""
)


@query(_COLD + " select dimension, stratum, count(*) as n, round(avg((rank <= 10)::int), 6) as gold from b group by all")
def cold_start_strata(spark, sf):
    """Popularity's hits of held-out nodes, by the gold model's visible datasets and by the task's."""
    e = cut(inputs.edges(spark, sf).join(_split(spark, sf).select(F.col("root").alias("dataset"), "side"), "dataset"), "sided")
    visible = e.where("side <> 'test'").select(F.col("model").alias("item"), "dataset", "task")
    pick = F.struct("weight", (-F.col("model")).alias("m"))
    gold = e.where("side = 'test'").groupBy("dataset", "task").agg(F.max_by("model", pick).alias("item"))
    degree = visible.groupBy("item").agg(F.countDistinct("dataset").alias("d"))
    counts = degree.groupBy("d").agg(F.count("*").alias("k"))  # one row a degree: few, as degrees repeat
    mine = gold.join(degree, "item", "left").fillna(0, ["d"])
    above = mine.select("d").distinct().join(counts.select(F.col("d").alias("o"), "k"), F.col("o") > F.col("d"), "left")
    ranks = above.groupBy("d").agg((F.coalesce(F.sum("k"), F.lit(0)) + 1).alias("rank"))
    g = mine.join(ranks, "d").select(F.concat_ws(":", "dataset", "task").alias("query"), "item", "task", "rank")
    return cohorts.cold_start(g, visible).select("dimension", "stratum", "n", r6("gold"))


_TOKENS = ("Other", "qa", "ner", "asr", "ocr", "vqa", "tts")


@query(
    """with n as (select p_partkey as id, p_partkey % 4 as task_id from part)
 select case when id % 8 = 0 then 4 + id % 3 else task_id end as task_id, count(*) as n from n group by all"""
)
def task_repair(spark, sf):
    """Reviewed replacements of nodes without a task, by an extended vocabulary."""
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("task_id"))
    action = F.when(F.col("id") % 8 == 0, "replace_Other_after_review").otherwise("keep")
    patch = nodes.where("id % 4 = 0").select("id", action.alias("action"), (4 + F.col("id") % 3).alias("task_id"))
    new = spark.createDataFrame([(t, i) for i, t in enumerate(_TOKENS)], "token string, id long")
    out = cohorts.repair_tasks(nodes, patch, new.where("id < 4"), new)
    return out.groupBy("task_id").agg(F.count("*").alias("n"))


@query("select p_size as kind, count(*) as n, sum(p_partkey)::bigint as ids from part group by all")
def attached_ids(spark, sf):
    """Task ids joined to nodes by key: each node has exactly one."""
    p = table(spark, sf, "part")
    ids = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("kind"))
    out = cohorts.attach_ids(p.select(F.col("p_partkey").alias("id")), ids, "id", "kind")
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(
    with_ctes("sc", "lab")
    + _SL
    + """, m as (select count(*) as n, avg((score - value) ** 2) as mse from sl), e as (select query from sl group by query having count(*) >= 3),
 p as (select a.query, sign(a.score - b.score) as x, sign(a.value - b.value) as y from sl a semi join e using (query) join sl b on a.query = b.query and a.item < b.item),
 t as (select query, sum(x * y) / nullif(sqrt(sum(abs(x))::double * sum(abs(y))), 0) as tau from p group by all)
 select n, round(mse, 6) as mse, (select count(tau) from t) as n_queries, round((select avg(tau) from t), 6) as tau_macro from m"""
)
def prediction_quality(spark, sf):
    """Squared error and mean rank correlation of similarities as predictions of the recorded values."""
    return cohorts.prediction_quality(_labelled(spark, sf)).select("n", r6("mse"), "n_queries", r6("tau_macro"))


@query(_SUP + " select src, arg_max(dst, (w, -dst)) as dst from sup group by src")
def best_dataset_per_model(spark, sf):
    return cohorts.best_dataset(_supply(spark, sf))


_UNIT = """u as (select item, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as z from vec),
 px as (select item, label, unnest(z) as x, generate_subscripts(z, 1) as i from u)"""


@query(
    with_ctes("vec")
    + f""", {_UNIT}, s as (select label, i, sum(x) as s, count(*) as n from px group by all)
 select label, n, (n * (n - 1) // 2)::bigint as pairs, round((sum(s * s) - n) / nullif(n * (n - 1), 0), 6) as mean_cos from s group by label, n"""
)
def same_label_cosine(spark, sf):
    """Mean cosine of all pairs inside a label, without making a pair."""
    return cohorts.pair_cosine(inputs.vectors(spark, sf), ["label"]).select("label", "n", "pairs", r6("mean_cos"))


@query(
    with_ctes("vec")
    + _LAYERS
    + f""", {_UNIT}, s as (select layer, ly.model % 3 <> 0 as in_snapshot, i, sum(x) as s, count(*) as n from px join ly on ly.model = px.item group by all)
 select layer, in_snapshot, n, round((sum(s * s) - n) / nullif(n * (n - 1), 0), 6) as mean_cos from s group by layer, in_snapshot, n"""
)
def layer_geometry(spark, sf):
    """Models of each layer inside and outside the snapshot, and how alike their vectors are."""
    ly = _layers(spark, sf).select(F.col("model").alias("item"), "layer")
    v = inputs.vectors(spark, sf).join(ly, "item").withColumn("in_snapshot", F.col("item") % 3 != 0)
    return cohorts.pair_cosine(v, ["layer", "in_snapshot"]).select("layer", "in_snapshot", "n", r6("mean_cos"))


@query(
    """with b as (select l_suppkey as src, l_partkey as dst from lineitem union all select l_partkey, l_suppkey from lineitem),
 d as (select src, least(10, count(distinct dst)) as d from b where src <> dst group by all) select sum(d)::bigint as n from d"""
)
def similarity_degree(spark, sf):
    """Edges of a symmetric relation after the cap of each end's neighbours."""
    return cohorts.similarity_degree(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query(
    """with c as (select p_partkey % 6 as family, p_size % 9 as bucket from part)
 select 'family' as category, count(distinct family) as observed, (max(family) + 1)::bigint as cardinality, round(100 * avg((family = 0)::int), 6) as unknown_percent from c
 union all select 'bucket', count(distinct bucket), (max(bucket) + 1)::bigint, round(100 * avg((bucket = 0)::int), 6) from c"""
)
def category_facts(spark, sf):
    """Sizes of id columns and shares of their unknown id."""
    c = table(spark, sf, "part").select((F.col("p_partkey") % 6).alias("family"), (F.col("p_size") % 9).cast("long").alias("bucket"))
    return cohorts.category_facts(c, ["family", "bucket"]).select("category", "observed", "cardinality", r6("unknown_percent"))


@query(
    _SIDES
    + """ select count(*) as n_edges, count(distinct src) as n_models, count(distinct dst) as n_datasets, count(*) filter (side = 'train' and role = 'message') as messages,
 count(*) filter (side = 'train' and role = 'label') as supervision, count(distinct dst) filter (side = 'train') as visible_datasets, count(*) filter (side = 'test') as test_positives from ro"""
)
def split_facts(spark, sf):
    """What a root-aware split leaves visible, supervises and tests."""
    return cohorts.split_facts(_roles(spark, sf)[2])


@query(None)
def separability(spark, sf):
    """How well halves of the vectors tell odd labels from even ones; rows agree on reruns, tests hold the measure to planted data."""
    v = inputs.vectors(spark, sf).select("item", "v", (F.col("label") % 2).alias("y"))
    return cohorts.separability(v, {"full": (0, 64), "first": (0, 32), "second": (32, 64)})


_FACTS = "select distinct dataset, dataset % 8 as root, task, 'set ' || (dataset % 8) || case when dataset % 3 = 0 then ' copy' else ' other subject' || dataset end as name, dataset % 4 <> 1 as visible from e0"
_LEAVE = (
    with_ctes("edges")
    + f""", e0 as (select dataset * 2 + (task = 'O')::int as dataset, task, model as item, weight as w from edges), f as ({_FACTS}),
 e as (select e0.dataset, e0.item, e0.w, f.root, f.task, f.name, f.visible from e0 join f using (dataset)), q as (select * from f where not visible),
 tri as (select name, list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3))) as g from (select distinct name from f)),
 far as (select a.name as x, b.name as y, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) <= 0.5 as far from tri a, tri b),
 sib as (select q.dataset as query, e.item, avg(w) as sib, avg(w) filter (far.far) as sib_nd from q join e on e.root = q.root and e.dataset <> q.dataset
 join far on far.x = q.name and far.y = e.name group by all),
 tk as (select q.dataset as query, e.item, case when count(*) filter (e.visible) > 0 then (coalesce(sum(w) filter (e.visible), 0) + 2.5) / (count(*) filter (e.visible) + 5) end as task_a,
 (sum(w) + 2.5) / (count(*) + 5) as task_b from q join e on e.task = q.task and e.dataset <> q.dataset group by all),
 bo as (select query, item, 'sib' as source, sib as boost from sib union all select query, item, 'sib_nd', sib_nd from sib
 union all select query, item, 'task_a', task_a from tk union all select query, item, 'task_b', task_b from tk)"""
)


def _leave_out(spark, sf):
    """(edges, facts, boosts, scored, gold): nodes are datasets, every fourth is held out; items are those seen in the node's task."""
    e = inputs.edges(spark, sf).select((F.col("dataset") * 2 + (F.col("task") == "O").cast("int")).alias("dataset"), "task", F.col("model").alias("item"), F.col("weight").alias("w"))
    e = cut(e, "nodes")
    e.createOrReplaceTempView("leave_out_nodes")
    facts = cut(spark.sql(_FACTS.replace("e0", "leave_out_nodes")), "facts")
    held = facts.where("not visible")
    boosts = cut(cohorts.leave_out_boosts(e.drop("task"), facts, held.select(F.col("dataset").alias("query"))), "boosts")
    items = e.select("task", "item").distinct()
    score = ((F.col("item") * 7919 + F.col("dataset") * 104729) % 101).cast("double")
    scored = held.join(items, "task").select(F.col("dataset").alias("query"), "item", score.alias("score"))
    pick = F.struct("w", (-F.col("item")).alias("i"))
    gold = e.join(held.select("dataset"), "dataset").groupBy(F.col("dataset").alias("query")).agg(F.max_by("item", pick).alias("item"))
    return boosts, scored, gold


@query(_LEAVE + " select query, item, source, round(boost, 6) as boost from bo where boost is not null")
def leave_out_boosts(spark, sf):
    """What siblings and tasks say of items, without the query's own edges."""
    return _leave_out(spark, sf)[0].select("query", "item", "source", r6("boost"))


_VARIANT = (
    _LEAVE
    + """, s0 as (select q.dataset as query, i.item, ((i.item * 7919 + q.dataset * 104729) % 101)::double as score from q join (select distinct task, item from e0) i using (task)),
 s1 as (select query, item, (score - min(score) over w) / greatest(max(score) over w - min(score) over w, 1e-9) as mips from s0 window w as (partition by query)),
 wd as (select query, item, coalesce(max(boost) filter (source = 'sib'), 0) as sib, coalesce(max(boost) filter (source = 'sib_nd'), 0) as sib_nd,
 coalesce(max(boost) filter (source = 'task_a'), 0) as task_a, coalesce(max(boost) filter (source = 'task_b'), 0) as task_b from bo group by all),
 s2 as (select s1.query, s1.item, mips, coalesce(sib, 0) as sib, coalesce(sib_nd, 0) as sib_nd, coalesce(task_a, 0) as task_a, coalesce(task_b, 0) as task_b from s1 left join wd using (query, item)),
 lg as (select query, item, unnest(['mips', 'A_task', 'B_sib', 'B_sib_namedistinct', 'B_sib_taskA', 'B_task', 'B_sib_taskB']) as variant,
 unnest([round(mips, 9), round(mips + task_a, 9), round(mips + sib, 9), round(mips + sib_nd, 9), round(mips + sib + task_a, 9), round(mips + task_b, 9), round(mips + sib + task_b, 9)]) as s from s2),
 gd as (select dataset as query, arg_max(item, (w, -item)) as item from e semi join q using (dataset) group by all),
 rk as (select me.query, me.variant, count(*) filter (o.s > me.s) + 1 as rank from lg me join gd using (query, item) join lg o on o.query = me.query and o.variant = me.variant group by all)"""
)


@query(_VARIANT + " select variant, count(*) as n, round(avg((rank <= 10)::int), 6) as gold_10, median(rank) as median_rank from rk group by all")
def leave_out_variants(spark, sf):
    """Gold's place by similarity alone and with each mix of leave-out boosts."""
    boosts, scored, gold = _leave_out(spark, sf)
    ranks = cohorts.variant_ranks(scored, boosts, gold)
    return ranks.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg((F.col("rank") <= 10).cast("int")), 6).alias("gold_10"), F.median("rank").alias("median_rank"))


@query(
    _VARIANT
    + """, g as (select avg((rank <= 10)::int) filter (variant = 'A_task') as held, avg((rank <= 10)::int) filter (variant = 'B_sib_taskB') as whole from rk)
 select round(held, 6) as held, round(whole, 6) as "full", held <= whole as ok from g"""
)
def leakage_gate(spark, sf):
    """Held-out evidence must not find more gold than all evidence."""
    boosts, scored, gold = _leave_out(spark, sf)
    ranks = cut(cohorts.variant_ranks(scored, boosts, gold), "variants")
    out = cohorts.leakage_gate(ranks.where("variant = 'A_task'"), ranks.where("variant = 'B_sib_taskB'"))
    return out.select(r6("held"), r6("full"), "ok")


@query(
    """with g as (select o_orderkey as query, o_custkey as item, o_totalprice as value from orders), e as (select l_suppkey as item, l_partkey as dataset, l_discount as w from lineitem),
 c as (select p_partkey as dataset, p_brand as root, p_size as code from part), l as (select (select max(p_partkey) + 1 from part) as nd, (select max(s_suppkey) + 1 from supplier) as ni)
 select 'gold_query_known' as rule, count(*) filter (not coalesce(query >= 0 and query < nd, false)) as n from g, l
 union all select 'gold_item_known', count(*) filter (not coalesce(item >= 0 and item < ni, false)) from g, l
 union all select 'gold_value_finite', count(*) filter (not coalesce(isfinite(value), false)) from g
 union all select 'gold_not_empty', (count(*) = 0)::int from g
 union all select 'edge_item_known', count(*) filter (not coalesce(item >= 0 and item < ni, false)) from e, l
 union all select 'edge_dataset_known', count(*) filter (not coalesce(dataset >= 0 and dataset < nd, false)) from e, l
 union all select 'edge_weight_finite', count(*) filter (not coalesce(isfinite(w), false)) from e
 union all select 'vector_finite', count(*) filter (len(list_filter(embedding, lambda x: not isfinite(x))) > 0) from embeddings
 union all select 'vector_unit', count(*) filter (abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) > 1e-5) from embeddings
 union all select 'gold_pairs_unique', count(*) from (select 1 from g group by query, item having count(*) > 1)
 union all select 'edge_pairs_unique', count(*) from (select 1 from e group by item, dataset having count(*) > 1)
 union all select 'one_code_a_root', count(*) from (select 1 from c group by root having count(distinct code) > 1)
 union all select 'one_root_a_code', count(*) from (select 1 from c group by code having count(distinct root) > 1)
 union all select 'held_out_roots_unseen', count(*) from (select root from g join c on c.dataset = g.query intersect select root from e join c using (dataset))"""
)
def payload_checks(spark, sf):
    """All rules of an evaluation payload over whole tables that break some of them."""
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    n_datasets = part.agg(F.max("p_partkey") + 1).first()[0]
    n_items = supplier.agg(F.max("s_suppkey") + 1).first()[0]
    gold = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_custkey").alias("item"), F.col("o_totalprice").alias("value"))
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("dataset"), F.col("l_discount").alias("w"))
    codes = part.select(F.col("p_partkey").alias("dataset"), F.col("p_brand").alias("root"), F.col("p_size").alias("code"))
    return cohorts.payload_checks(gold, edges, codes, inputs.vectors(spark, sf), n_items, n_datasets)


_HALO = """select 'm' || p_partkey as id, case when p_partkey % 5 <> 0 then 'text' end as pipeline, case when p_partkey % 3 = 0 then array('a') end as tags,
 case when p_partkey % 2 = 0 then p_size end as size, p_partkey % 9 = 0 as labelled, case when p_partkey % 4 = 1 then 'M' || (p_partkey * 3 % 250) end as base from part where p_partkey % 4 <> 0"""


@query(
    f"""with h as ({_HALO.replace("array('a')", "['a']")}), c as (select 'm' || p_partkey as id, coalesce(d, 0) as degree from part
 left join (select l_partkey as p_partkey, count(*) - 25 as d from lineitem group by all) using (p_partkey) where p_partkey % 4 = 0),
 lake as (select lower(id) as b, max(core) as core from (select id, 0 as core from h union all select id, 1 from c) group by all),
 j as (select h.*, case when pipeline is null and tags is null and size is null then 'dropped' when labelled then 'labeled' when base is not null then 'lineage' else 'plain' end as layer,
 core, lake.b is not null and lower(base) <> id as hit from h left join lake on lake.b = lower(base)),
 o as (select count(*) filter (layer = 'labeled') as labeled, count(*) filter (layer = 'lineage') as lineage, count(*) filter (layer = 'plain') as plain, count(*) filter (layer = 'dropped') as dropped,
 count(base) as declared, count(*) filter (hit) as resolved, count(*) filter (hit and core = 1) as resolved_in_core, count(size) as with_size, count(*) as halo from j),
 w as (select count(*) filter (degree >= 10) as warm, count(*) filter (degree between 1 and 9) as cool, count(*) filter (degree = 0) as z from c),
 a as (select o.*, warm, cool, resolved as cold, halo - resolved + z as frozen from o, w) unpivot a on columns(*) into name fact value n"""
)
def lake_forecast(spark, sf):
    """Layers, resolvable bases and strata of a lake before it is built."""
    p = table(spark, sf, "part")
    p.createOrReplaceTempView("forecast_part")
    halo = spark.sql(_HALO.replace("from part", "from forecast_part"))
    ids = p.where("p_partkey % 4 = 0").select("p_partkey", F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"))
    degree = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.count("*") - 25).alias("degree"))
    return cohorts.forecast(halo, ids.select("id"), ids.join(degree, "p_partkey").select("id", "degree"))


@query(
    """with m as (select distinct l_suppkey as id, l_partkey as dataset, l_suppkey // 64 as batch from lineitem)
 select batch, x.id as a, y.id as b from m x join m y using (batch, dataset) where x.id < y.id group by all"""
)
def batch_pairs(spark, sf):
    """Pairs of models of a batch that share a dataset, for all batches of 64 models."""
    li = table(spark, sf, "lineitem")
    members = li.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("dataset"))
    batch = members.select("id", F.floor(F.col("id") / 64).alias("batch")).distinct()
    return cohorts.batch_mask(members, batch)


@query(
    "select * from (values "
    + ", ".join(f"('{k}', {v}::double)" for k, v in [("min_models", 3), ("near_gap", 0.01), ("shrink", 5), ("test_share", 0.2), ("validation_share", 0.1)])
    + ", ('supervision_share', 0.3::double), ('positive_share', 0.1::double), ('low_quantile', 0.3::double), ('scale_limit', 1.5::double)) as t(rule, value)"
)
def gold_rules(spark, sf):
    """The knobs of the definition of gold as rows."""
    return cohorts.GoldRules().row(spark)


@query(
    with_ctes("vec")
    + """, c as (select item, v[1:3] as p from vec), s as (select quantile_cont(abs(x), 0.999) * 1.02 as scale from (select unnest(p) as x from c))
 select item, list_transform(p, lambda x: greatest(-32767, least(32767, round_even(x / scale * 32000.0, 0)::int))) as q from c, s"""
)
def packed_layout(spark, sf):
    """Three coordinates of each vector as whole numbers on a common scale."""
    p = inputs.vectors(spark, sf).select("item", F.transform(block(F.col("v"), 0, 3), lambda x: x.cast("double")).alias("p"))
    return vectors.quantise(p)


@query(
    """with n as (select p_size % 40 as family, count(*) as n from part where p_size % 40 <> 0 group by all having count(*) >= 3)
 select family, n, (row_number() over (order by n desc, family))::int as slot from n qualify slot <= 26"""
)
def family_slots(spark, sf):
    """The largest families in order, numbered for display."""
    return vectors.slots(table(spark, sf, "part").select((F.col("p_size") % 40).alias("family")), least=3)


@query(
    with_ctes("vec")
    + """ select item, len(list_concat(v[1:8], v[61:64], [label::double])) as n, round(list_sum(list_concat(v[1:8], v[61:64], [label::double])), 6) as total from vec"""
)
def joined_features(spark, sf):
    """Blocks of a vector and a category as one feature vector."""
    v = inputs.vectors(spark, sf)
    one = joined(block(F.col("v"), 0, 8), block(F.col("v"), 60, 4), F.array(F.col("label").cast("float")))
    x = v.select("item", F.transform(one, lambda c: c.cast("double")).alias("x"))
    return x.select("item", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda t, c: t + c), 6).alias("total"))
