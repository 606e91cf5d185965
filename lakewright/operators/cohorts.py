"""Cohorts of queries and models: card matching, strata, repairs, separability, payload checks, forecasts."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.functions.text import normal_id, trigrams
from lakewright.functions.vector import dot, norm, sound, unit
from lakewright.operators import checks, ranking
from lakewright.operators.lexical import jaccard
from lakewright.operators.prior import SHRINK, shrunken

# fixed values: how a dataset node came by its card
CARD, PARENT, NAME_ONLY = "hf_card", "hf_card_via_parent", "name_only"
AMBIGUOUS, REJECTED = "name_only_ambiguous", "name_only_cross_owner_rejected"

# fixed values: bands of a gold model's training degree, and of a task's training datasets: (from, to, label)
DEGREE_BANDS = ((0, 2, "cold (<=2)"), (3, 10, "mid (3-10)"), (11, None, "warm (>=11)"))
TASK_BANDS = ((0, 5, "rare task (<=5)"), (6, 50, "mid (6-50)"), (51, None, "common task (>=51)"))


def match_cards(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """``nodes`` (dataset) with card_source and matched_id by the ids of ``cards`` (id).

    An equal id matches; a name without owner matches the one card whose last part it is (several: ambiguous); a name with
    owner is else rejected if any card has its last part. Names with owner left without a card take the card of the
    owner part: an equal id, or the one card with that last part. Every join is on equality; nothing is collected.
    """
    c = cards.select(normal_id(F.col("id")).alias("id")).where("id is not null")
    exact = c.select(F.col("id").alias("dsn"), F.lit(True).alias("_e")).distinct()
    parents = c.select(F.col("id").alias("_parent"), F.lit(True).alias("_pe")).distinct()
    last = c.withColumn("_b", F.element_at(F.split("id", "/"), -1)).groupBy("_b").agg(F.count("*").alias("_n"), F.min("id").alias("_one"))
    by_parent = last.select(F.col("_b").alias("_parent"), F.col("_n").alias("_pn"), F.col("_one").alias("_pone"))
    n = nodes.withColumn("dsn", normal_id(F.col("dataset"))).withColumn("_owned", F.contains("dsn", F.lit("/")))
    n = n.withColumn("_b", F.element_at(F.split("dsn", "/"), -1))
    n = n.withColumn("_parent", F.when(F.col("_owned"), F.element_at(F.split("dsn", "/"), 1)))
    j = n.join(exact, "dsn", "left").join(last, "_b", "left").join(parents, "_parent", "left").join(by_parent, "_parent", "left")
    via = F.when(F.col("_pe"), F.col("_parent")).when(F.col("_pn") == 1, F.col("_pone"))
    owned = F.when(via.isNotNull(), PARENT).when(F.col("_n") > 0, REJECTED).otherwise(NAME_ONLY)
    bare = F.when(F.col("_n") == 1, CARD).when(F.col("_n") > 1, AMBIGUOUS).otherwise(NAME_ONLY)
    how = F.when(F.col("_e"), CARD).when(F.col("_owned"), owned).otherwise(bare)
    found = F.when(F.col("_e"), F.col("dsn")).when(F.col("_owned"), via).when(F.col("_n") == 1, F.col("_one"))
    return j.select(*nodes.columns, how.alias("card_source"), found.alias("matched_id"))


def strata(ranks: DataFrame, value: Column, bands: tuple, dimension: str, k: int = 10) -> DataFrame:
    """(dimension, stratum, n, gold): share of queries with gold in the first k, by bands of a value; empty bands have no row."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(bands):
        inside = value >= low if high is None else value.between(low, high)
        label = F.when(inside, F.lit(name)).otherwise(label)
    g = ranks.groupBy(label.alias("stratum")).agg(F.count("*").alias("n"), F.avg(ranking.hit(F.col("rank"), k)).alias("gold"))
    return g.where("stratum is not null").select(F.lit(dimension).alias("dimension"), "stratum", "n", "gold")


def cold_start(gold: DataFrame, visible: DataFrame, k: int = 10) -> DataFrame:
    """Strata of queries by their gold model's number of visible datasets and by their task's number of visible datasets.

    ``gold``: (query, item, task, rank); ``visible``: edges (item, dataset, task) of datasets that are no queries.
    """
    seen = visible.groupBy("item").agg(F.countDistinct("dataset").alias("degree"))
    peers = visible.groupBy("task").agg(F.countDistinct("dataset").alias("peers"))
    j = gold.join(seen, "item", "left").join(peers, "task", "left").fillna(0, ["degree", "peers"])
    by_degree = strata(j, F.col("degree"), DEGREE_BANDS, "gold_degree", k)
    return by_degree.unionByName(strata(j, F.col("peers"), TASK_BANDS, "task_peers", k))


def repair_tasks(nodes: DataFrame, patch: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` (id, task_id) with reviewed replacements of ``patch`` (id, action, task_id), where a node's task was other (0).

    Vocabularies (token, id): the new one must number its tokens from 0 (Other) without a gap and keep all old pairs. A patch of
    an unknown node, of a node with a task, or to an unknown task was made for another graph. Each fault raises ValueError.
    """
    seen = new.agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.countDistinct("token").alias("tokens"), F.max((F.col("token").eqNullSafe("Other") & (F.col("id") == 0)).cast("int")).alias("other"),
    ).first()
    if not (seen.n and seen.n == seen.ids == seen.tokens and seen.lo == 0 and seen.hi == seen.n - 1 and seen.other):
        raise ValueError("the vocabulary must number its tokens from 0 (Other) without a gap")
    if old.select("token", "id").exceptAll(new.select("token", "id")).take(1):
        raise ValueError("the vocabulary must keep the old ids")
    use = patch.where("action = 'replace_Other_after_review'").select("id", F.col("task_id").alias("_new"))
    one = nodes.select("id", "task_id")
    wrong = use.join(one, "id", "left").where("task_id is null or task_id <> 0")
    unknown = use.join(new.select(F.col("id").alias("_new")), "_new", "left_anti")
    if wrong.take(1) or unknown.take(1) or use.groupBy("id").count().where("count > 1").take(1):
        raise ValueError("the patch was made for another graph")
    return nodes.join(use, "id", "left").withColumn("task_id", F.coalesce("_new", "task_id")).drop("_new")


def attach_ids(nodes: DataFrame, ids: DataFrame, on: str, column: str) -> DataFrame:
    """``nodes`` with ``column`` of ``ids``; raises if a node has none or several."""
    if ids.groupBy(on).count().where("count > 1").take(1):
        raise ValueError("a node has several ids")
    out = nodes.join(ids.select(on, column), on, "left")
    if out.where(F.col(column).isNull()).take(1):
        raise ValueError("a node has no id")
    return out


def prediction_quality(scored: DataFrame, least: int = 3) -> DataFrame:
    """(n, mse, n_queries, tau_macro) of (query, item, score, value).

    The rank correlation is the mean over queries with ``least`` candidates or more whose scores and values both vary.
    """
    whole = scored.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("score") - F.col("value"), 2)).alias("mse"))
    tau = ranking.kendall(scored, least).where("tau is not null")
    return whole.crossJoin(tau.agg(F.count("*").alias("n_queries"), F.avg("tau").alias("tau_macro")))  # one row each


def best_dataset(edges: DataFrame) -> DataFrame:
    """(src, dst): each model's dataset of the largest weight; ties to the smaller dataset."""
    return edges.groupBy("src").agg(F.min_by("dst", F.struct((-F.col("w")).alias("w"), "dst")).alias("dst"))


def pair_cosine(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by ..., n, pairs, mean_cos): mean cosine over all pairs of a group, from the length of the sum of its unit vectors.

    No pair is made and none is sampled: (|sum|^2 - n) / (n (n - 1)). Groups of one have null; vectors that are null, zero or
    not finite take no part. Sums are combined before the shuffle.
    """
    good = vectors.where(F.col("v").isNotNull() & sound(F.col("v"))).where(norm(F.col("v")) > 0)
    z = good.select(*by, array_to_vector(unit(F.col("v"), 0.0)).alias("z"))
    s = z.groupBy(*by).agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(F.col("z"))).alias("s"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = F.when(F.col("n") > 1, (dot(F.col("s"), F.col("s")) - F.col("n")) / pairs)
    return s.select(*by, "n", F.floor(pairs / 2).alias("pairs"), mean.alias("mean_cos"))


def similarity_degree(edges: DataFrame, k: int = 10) -> DataFrame:
    """(n): edges left when each end keeps at most k distinct neighbours of the symmetric relation, loops apart."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    return both.groupBy("src").agg(F.least(F.countDistinct("dst"), F.lit(k)).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n"))


def category_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(category, observed, cardinality, unknown_percent) of id columns from 0 (unknown), in one pass."""
    facts = [
        F.struct(
            F.lit(c).alias("category"), F.countDistinct(c).alias("observed"), F.coalesce(F.max(c) + 1, F.lit(0)).cast("long").alias("cardinality"),
            (100 * F.avg((F.col(c) == 0).cast("int"))).alias("unknown_percent"),
        )
        for c in columns
    ]
    return df.agg(F.array(*facts).alias("f")).select(F.inline("f"))


def split_facts(roles: DataFrame) -> DataFrame:
    """(n_edges, n_models, n_datasets, messages, supervision, visible_datasets, test_positives) of edges with side and role."""
    train = F.col("side") == "train"
    return roles.agg(
        F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_models"), F.countDistinct("dst").alias("n_datasets"),
        F.count_if(train & (F.col("role") == "message")).alias("messages"), F.count_if(train & (F.col("role") == "label")).alias("supervision"),
        F.countDistinct(F.when(train, F.col("dst"))).alias("visible_datasets"), F.count_if(F.col("side") == "test").alias("test_positives"),
    )


def separability(vectors: DataFrame, slices: dict[str, tuple[int, int]], most: int = 20_000, rounds: int = 200) -> DataFrame:
    """(slice, n_per_class, auc): how well a logistic model on half of the rows tells the classes of the other half.

    ``vectors``: (item, v, y in 0 and 1). ``most`` bounds the rows of a class; both have as many, in a hash order of the items;
    odd places learn, even ones are scored. Vectors are standardised by the learning half. A class without two rows raises.
    """
    sizes = {r.y: r["count"] for r in vectors.groupBy("y").count().collect()}  # two classes
    m = min(most, sizes.get(0, 0), sizes.get(1, 0))
    if m < 2:
        raise ValueError("each class needs two rows")
    h = F.md5(F.col("item").cast("string"))
    near = vectors.where((F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / (1 << 32)) <= F.when(F.col("y") == 0, min(1.0, 2 * m / sizes[0])).otherwise(min(1.0, 2 * m / sizes[1])))
    r = F.row_number().over(Window.partitionBy("y").orderBy(h, "item"))
    some = near.withColumn("_r", r).where(F.col("_r") <= m).select("_r", F.col("y").cast("double").alias("y"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    some = some.cache()
    rows = []
    for name, (start, end) in slices.items():
        x = some.withColumn("x", array_to_vector(F.slice("v", start + 1, end - start)))
        scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(x.where("_r % 2 = 1"))
        model = LogisticRegression(featuresCol="z", labelCol="y", maxIter=rounds).fit(scaler.transform(x.where("_r % 2 = 1")))
        out = model.transform(scaler.transform(x.where("_r % 2 = 0")))
        auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="y", numBins=0).evaluate(out)
        rows.append((name, m, round(auc, 4)))
    some.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "slice string, n_per_class long, auc double")


def leave_out_boosts(edges: DataFrame, facts: DataFrame, queries: DataFrame, most: float = 0.5) -> DataFrame:
    """(query, item, source, boost): what a query's siblings and its task say of items, never the query's own edges.

    ``edges``: (dataset, item, w); ``facts``: (dataset, root, task, name, visible); ``queries``: (query). Sources: ``sib``, the mean
    over other datasets of the root; ``sib_nd``, over those whose names' trigrams have a Jaccard of ``most`` or less;
    ``task_a`` and ``task_b``, shrunken means over other datasets of the task, the visible ones or all.
    """
    e = edges.join(facts, "dataset")
    q = queries.join(facts.select(F.col("dataset").alias("query"), "root", "task", F.col("name").alias("own")), "query")
    sib = q.select("query", "root", "own").join(e.select("root", "dataset", "item", "w", "name"), "root").where("dataset <> query")
    sib = sib.withColumn("far", jaccard(trigrams(F.col("own")), trigrams(F.col("name"))) <= most)
    mean = sib.groupBy("query", "item").agg(F.avg("w").alias("sib"), F.avg(F.when(F.col("far"), F.col("w"))).alias("sib_nd"))
    out = mean.select("query", "item", F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("boost")) for s in ("sib", "sib_nd")])))
    own = e.select(F.col("dataset").alias("query"), "item", "w", "visible").groupBy("query", "item").agg(
        F.sum("w").alias("own_b"), F.count("*").alias("on_b"), F.sum(F.when(F.col("visible"), F.col("w")).otherwise(0.0)).alias("own_a"),
        F.count_if(F.col("visible")).alias("on_a"),
    )
    total = e.groupBy("task", "item").agg(
        F.sum("w").alias("t_b"), F.count("*").alias("n_b"), F.sum(F.when(F.col("visible"), F.col("w")).otherwise(0.0)).alias("t_a"),
        F.count_if(F.col("visible")).alias("n_a"),
    )
    j = q.select("query", "task").join(total, "task").join(own, ["query", "item"], "left").fillna(0, ["own_a", "own_b", "on_a", "on_b"])
    rest = lambda s: (F.col(f"t_{s}") - F.col(f"own_{s}"), F.col(f"n_{s}") - F.col(f"on_{s}"))
    boost = lambda s: F.when(rest(s)[1] > 0, shrunken(*rest(s), SHRINK))
    task = j.select("query", "item", F.inline(F.array(*[F.struct(F.lit(f"task_{s}").alias("source"), boost(s).alias("boost")) for s in "ab"])))
    return out.unionByName(task).where("boost is not null")


# fixed values: which boosts each variant adds to the similarity
VARIANTS = {
    "mips": (), "A_task": ("task_a",), "B_sib": ("sib",), "B_sib_namedistinct": ("sib_nd",),
    "B_sib_taskA": ("sib", "task_a"), "B_task": ("task_b",), "B_sib_taskB": ("sib", "task_b"),
}


def variant_ranks(scored: DataFrame, boosts: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, variant, rank): gold's rank (one more than the items above it) by similarity scaled to 0..1 a query, plus boosts.

    ``scored``: (query, item, score), joined with the boosts by key. A query whose gold is not among its items has no row.
    """
    by = Window.partitionBy("query")
    lo, hi = F.min("score").over(by), F.max("score").over(by)
    names = sorted({s for v in VARIANTS.values() for s in v})
    wide = boosts.groupBy("query", "item").agg(*[F.max(F.when(F.col("source") == s, F.col("boost"))).alias(s) for s in names])
    base = scored.withColumn("mips", (F.col("score") - lo) / F.greatest(hi - lo, F.lit(1e-9)))
    all_ = base.join(wide, ["query", "item"], "left").fillna(0.0, names)
    total = lambda parts: sum((F.col(p) for p in parts), F.col("mips"))
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.round(total(p), 9).alias("s")) for v, p in VARIANTS.items()])
    long = all_.select("query", "item", F.inline(each))
    me = long.join(gold.select("query", "item"), ["query", "item"]).select("query", "variant", F.col("s").alias("mine"))
    return long.join(me, ["query", "variant"]).groupBy("query", "variant").agg((F.count_if(F.col("s") > F.col("mine")) + 1).alias("rank"))


def leakage_gate(held: DataFrame, full: DataFrame, k: int = 10) -> DataFrame:
    """(held, full, ok): gold in the first k by held-out evidence must not beat gold by all evidence."""
    share = lambda d, name: d.agg(F.avg(ranking.hit(F.col("rank"), k)).alias(name))
    return share(held, "held").crossJoin(share(full, "full")).withColumn("ok", F.col("held") <= F.col("full"))  # one row each


def payload_checks(gold: DataFrame, edges: DataFrame, codes: DataFrame, vectors: DataFrame, n_items: int, n_datasets: int) -> DataFrame:
    """(rule, n): violations of an evaluation payload, each rule counted over all rows.

    ``gold``: (query, item, value); ``edges`` of the prior: (item, dataset, w); ``codes``: (dataset, root, code); ``vectors``: (v).
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    within = lambda c, n: (F.col(c) >= 0) & (F.col(c) < n)
    held = gold.select(F.col("query").alias("dataset")).distinct().join(codes, "dataset").select("root").distinct()
    seen = edges.select("dataset").distinct().join(codes, "dataset").select("root").distinct()
    repeated = lambda d, keys, name: checks.duplicate_keys(d, keys).select(F.lit(name).alias("rule"), "n")
    several = lambda a, b: codes.groupBy(a).agg(F.countDistinct(b).alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit(f"one_{b}_a_{a}").alias("rule"), "n")
    return checks.report(
        checks.violations(gold, {"gold_query_known": within("query", n_datasets), "gold_item_known": within("item", n_items), "gold_value_finite": finite("value")}),
        gold.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("n")).select(F.lit("gold_not_empty").alias("rule"), "n"),
        checks.violations(edges, {"edge_item_known": within("item", n_items), "edge_dataset_known": within("dataset", n_datasets), "edge_weight_finite": finite("w")}),
        checks.violations(vectors, {"vector_finite": sound(F.col("v")), "vector_unit": F.abs(norm(F.col("v")) - 1) <= 1e-5}),
        repeated(gold, ["query", "item"], "gold_pairs_unique"),
        repeated(edges, ["item", "dataset"], "edge_pairs_unique"),
        several("root", "code"),
        several("code", "root"),
        held.intersect(seen).agg(F.count("*").alias("n")).select(F.lit("held_out_roots_unseen").alias("rule"), "n"),
    )


def forecast(halo: DataFrame, core: DataFrame, degrees: DataFrame) -> DataFrame:
    """(fact, n): what a lake of core and halo models will hold: layers, resolvable bases, strata, sizes.

    ``halo``: (id, pipeline, tags, size, labelled, base); ``core``: (id); ``degrees``: (id, degree) of core models with evidence.
    """
    base = normal_id(F.col("base"))
    bare = F.col("pipeline").isNull() & (F.coalesce(F.size("tags"), F.lit(0)) <= 0) & F.col("size").isNull()
    layer = F.when(bare, "dropped").when(F.col("labelled"), "labeled").when(F.col("base").isNotNull(), "lineage").otherwise("plain")
    h = halo.withColumn("_id", normal_id(F.col("id"))).withColumn("_b", base).withColumn("_layer", layer)
    ids = h.select("_id", F.lit(False).alias("_c")).unionByName(core.select(normal_id(F.col("id")).alias("_id"), F.lit(True).alias("_c")))
    lake = ids.groupBy(F.col("_id").alias("_b")).agg(F.max("_c").alias("_core"))
    j = h.join(lake, "_b", "left")
    hit = F.col("_core").isNotNull() & (F.col("_b") != F.col("_id"))
    one = j.agg(
        *[F.count_if(F.col("_layer") == x).alias(x) for x in ("labeled", "lineage", "plain", "dropped")],
        F.count_if(F.col("_b").isNotNull()).alias("declared"), F.count_if(hit).alias("resolved"), F.count_if(hit & F.col("_core")).alias("resolved_in_core"),
        F.count_if(F.col("size").isNotNull()).alias("with_size"), F.count("*").alias("halo"),
    ).crossJoin(core.join(degrees, "id", "left").fillna(0, ["degree"]).agg(
        F.count_if(F.col("degree") >= 10).alias("warm"), F.count_if(F.col("degree").between(1, 9)).alias("cool"), F.count_if(F.col("degree") == 0).alias("bare_core"),
    ))
    one = one.withColumn("cold", F.col("resolved")).withColumn("frozen", F.col("halo") - F.col("resolved") + F.col("bare_core")).drop("bare_core")
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).alias("n")) for c in one.columns])))


def batch_mask(members: DataFrame, batch: DataFrame) -> DataFrame:
    """(batch, a, b): pairs of models of one batch that share a dataset of ``members`` (id, dataset).

    ``batch``: (id, batch). Batches are bounded, and with them the pairs of a dataset in a batch.
    """
    own = members.select("id", "dataset").distinct().join(batch, "id")
    left, right = own.withColumnRenamed("id", "a"), own.withColumnRenamed("id", "b")
    return left.join(right, ["batch", "dataset"]).where("a < b").select("batch", "a", "b").distinct()


@dataclass(frozen=True)
class GoldRules:
    """All knobs of the definition of gold, as one row to be written beside results."""

    min_models: int = 3
    near_gap: float = ranking.GAP
    shrink: int = SHRINK
    test_share: float = 0.2
    validation_share: float = 0.1
    supervision_share: float = 0.3
    positive_share: float = 0.1
    low_quantile: float = 0.3
    scale_limit: float = 1.5

    def row(self, spark) -> DataFrame:
        """(rule, value) rows in the order of the fields."""
        return spark.createDataFrame([(k, float(v)) for k, v in asdict(self).items()], "rule string, value double")
