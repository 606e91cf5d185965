"""Newer operators against brute force and toy fixtures."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright import storage
from lakewright.functions import text
from lakewright.functions.families import family_by_name
from lakewright.operators import audit, evaluation, evidence, graph, lexical, ordering, ranking, retrieval, splits, taxonomy, vectors, vocabulary
from lakewright.plans import catalog


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Unset:
        """A configuration without the setting."""

        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Unset()

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(Session())
    Session.sparkContext.master = "local[4]"
    assert storage.shared_root(Session()).startswith("file://")


def test_scopes_release_their_tables(spark):
    with storage.scope() as name:
        kept = storage.cut(spark.range(3), "x")
    path = storage._written[name][0]
    assert kept.count() == 3
    storage.release(spark, name)
    store, p = storage._filesystem(spark, path)
    assert not store.exists(p)


def test_running_numbers_and_sums(spark):
    rnd = random.Random(0)
    rows = [(i, rnd.randrange(50), rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a int, n int").repartition(7)
    got = {r.i: (r["row"], r.before) for r in ordering.running(df, [F.desc("a"), F.col("i")], {"before": "n"}).collect()}
    order, total, want = sorted(rows, key=lambda r: (-r[1], r[0])), 0, {}
    for k, (i, _, n) in enumerate(order, 1):
        want[i] = (k, total)
        total += n
    assert got == want
    assert ordering.running(df.limit(0), [F.col("i")]).count() == 0


def test_kendall_is_brute_force(spark):
    rnd = random.Random(1)
    rows = [(q, i, rnd.randrange(6) / 5, rnd.randrange(5) / 4) for q in range(12) for i in range(rnd.randrange(1, 30))]
    got = {r["query"]: r.tau for r in ranking.kendall(spark.createDataFrame(rows, "query long, item long, score double, value double"), least=1).collect()}
    for q in range(12):
        own = [(s, v) for k, _, s, v in rows if k == q]
        x = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for a, b in itertools.combinations(own, 2)]
        root = math.sqrt(sum(abs(a) for a, _ in x) * sum(abs(b) for _, b in x))
        assert got[q] == (pytest.approx(sum(a * b for a, b in x) / root) if root else None)


def test_bootstrap_covers_the_mean_and_is_deterministic(spark):
    d = spark.createDataFrame([(i, 0.1 + (i * 37 % 100 - 49.5) / 100) for i in range(200)], "query long, delta double")
    a, b = ranking.bootstrap(d, 2000).first(), ranking.bootstrap(d.repartition(5), 2000).first()
    assert a == b and a.n_paired == 200 and a.ci_low < a.mean_delta < a.ci_high
    spread = np.std([0.1 + (i * 37 % 100 - 49.5) / 100 for i in range(200)]) / math.sqrt(200)
    assert a.ci_high - a.ci_low == pytest.approx(2 * 1.96 * spread, rel=0.1) and a.prob_positive > 0.9
    assert ranking.bootstrap(d.limit(0), 100).first().ci_low is None


@pytest.mark.parametrize("block", [8192, 3])
def test_search_and_ranks_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERIES", block)
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((60, 4)), 1)
    x[10:20] = x[10]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, v array<double>")
    q = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(0, 60, 7)], "query long, q array<double>, task int")
    prior = [(t, i, (i * 31 + t) % 4 / 8) for t in range(3) for i in range(60) if i % 2]
    priors = spark.createDataFrame(prior, "task int, item long, prior double")
    known = {(t, i): p for t, i, p in prior}
    s = np.round(x @ x.T, 9)
    got = {}
    for r in retrieval.blocked_top_k(q, items, 5, skip_self=True).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["item"]
    for i in range(0, 60, 7):
        order = [j for j in sorted(range(60), key=lambda j: (-s[i, j], j)) if j != i]
        assert [got[i][k] for k in range(1, 6)] == order[:5]
    probes = spark.createDataFrame([(i, (i * 3) % 60) for i in range(0, 60, 7)], "query long, item long")
    tie = {j: (j * 11400714819323198485 + 15111065706836454659) % 2**64 for j in range(60)}
    one = lambda a, b: (np.float32(a) + np.float32(1)) / np.float32(2) + np.float32(b)
    for r in retrieval.full_ranks(q, items, probes, priors).collect():
        i, g = r["query"], r["item"]
        p = [known.get((i % 3, j), 0.0) for j in range(60)]
        fused = [one(s[i, j], p[j]) for j in range(60)]
        assert r["rank"] == 1 + sum(s[i, j] > s[i, g] for j in range(60))
        for name, v in (("fused_rank", fused), ("prior_rank", p)):
            assert r[name] == 1 + sum(v[j] > v[g] or v[j] == v[g] and tie[j] < tie[g] for j in range(60))


def test_pool_misses_stay_in_the_denominator(spark):
    pool = spark.createDataFrame([(0, i, s) for i, s in enumerate((0.9, 0.8, 0.7, 0.6))], "query long, item long, score double")
    whole = retrieval.fuse(pool, spark.createDataFrame([], "query long, item long, prior double"), ["query", "item"], 4)
    size = whole.groupBy("query").agg(F.count("*").alias("k"))
    gold = spark.createDataFrame([(0, 4)], "query long, item long")
    assert retrieval.gold_in_pool(whole, size, gold).first().asDict() == {"query": 0, "in_pool": False, "gold_rank": 5}


def test_merged_nodes_and_tasks(spark):
    df = spark.createDataFrame([("#", "deep-rl"), ("x", "robotics"), ("", "rl"), ("Custom", "Deep_RL"), ("-", "reinforcement-learning")], "d string, t string")
    got = [tuple(r) for r in df.select(evidence.is_rl(F.col("t")), evidence.is_placeholder(F.col("d")), evidence.is_placeholder(F.col("d"), merged=True)).collect()]
    assert got == [(True, False, True), (False, False, False), (True, False, True), (True, True, True), (True, False, True)]
    e = spark.createDataFrame([("d", "t", f"m{i}", "curated") for i in range(3)], "dataset string, task string, model string, direction string")
    assert [evidence.nodes(e, merged=m).first().gold_eligible for m in (False, True)] == [False, True]
    with pytest.raises(ValueError, match="one to one"):
        evidence.one_to_one(e, e, ["dataset"])


def test_trigrams_clean_names_and_keep_short_ones(spark):
    df = spark.createDataFrame([("A-b!",), ("ab",), ("Foo  Bar",), ("",)], "n string")
    assert [sorted(r[0]) for r in df.select(text.trigrams(F.col("n"))).collect()] == [["a b"], ["ab"], [" ba", "bar", "foo", "o b", "oo "], [""]]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_names_are_brute_force(spark, least):
    rnd = random.Random(4)
    names = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    sets = {r.name: set(r.t) for r in df.distinct().select("name", text.trigrams(F.col("name")).alias("t")).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    assert {(r.a, r.b) for r in lexical.trigram_similar(df, least).collect()} == want


def test_bm25_counts_kept_tokens_and_single_letters(spark):
    docs = spark.createDataFrame([(1, "a b c zz"), (2, "A a"), (3, "q q q"), (4, "q r"), (5, "x"), (6, "y"), (7, "u"), (8, "v")], "doc long, text string")
    q = spark.createDataFrame([(0, "a")], "query long, token string")
    got = {r["doc"]: r.score for r in lexical.bm25(q, lexical.term_counts(docs, "doc", "text")).collect()}
    # kept: a (documents 1, 2) and q (3, 4): lengths 1, 2, 3, 1; the mean is over all eight documents
    idf, mean = math.log(1 + 6.5 / 2.5), 7 / 8
    score = lambda tf, n: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    assert got == {1: pytest.approx(score(1, 1)), 2: pytest.approx(score(2, 2))}


def test_marks_go_in_turn(spark):
    names = ["a/model", "a/model-gguf-q4_k_m", "a/model-lora-8bit-q5-fp16", "a/model-peft-gguf-int4-q8-lora-bf16", "a/xy-gguf", "a/xy"]
    got = {r.name: r.base for r in graph.lineage_by_name(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {n: "a/model" for n in names[1:4]}


def test_negatives_leave_positives_out(spark):
    rows = [(m, 1, float(m)) for m in range(10)] + [(m, 2, 1.0) for m in range(2)]
    e = spark.createDataFrame(rows, "src long, dst long, w double")
    assert {(r.src, r.dst) for r in graph.known_low(e).collect()} == {(0, 1), (1, 1), (2, 1)}
    same = spark.createDataFrame([(m, 1, 1.0) for m in range(4)], "src long, dst long, w double")
    assert {r.src for r in graph.known_low(same).collect()} == {1, 2, 3}
    pairs = splits.negatives(e, e, spark.range(12).select("id"), spark.range(5).select("id"), 3).collect()
    assert len(pairs) == len(rows) and not {(r.src, r.dst) for r in pairs} & {r[:2] for r in rows}
    assert all(0 <= r.src < 12 and 0 <= r.dst < 5 for r in pairs)
    assert sorted(pairs) == sorted(splits.negatives(e.repartition(3), e, spark.range(12).select("id"), spark.range(5).select("id"), 3).collect())


def test_link_split_has_the_right_sizes(spark):
    e = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") % 7).alias("dst"))
    n = Counter(r.side for r in splits.link_split(e, 1).collect())
    assert n == {"test": 200, "val": 100, "disjoint": 210, "train": 490}


def test_sampling_mass_sums_to_one(spark):
    e = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "src long, dst long")
    m = spark.range(1, 5).select(F.col("id").alias("src"))
    for gamma in (0.0, 0.3):
        q = {r.src: r.q for r in graph.sampling_mass(e, m, gamma=gamma).collect()}
        assert sum(q.values()) == pytest.approx(1.0) and q[3] == q[4] > 0
        assert q[1] == pytest.approx((1 - gamma) * 3**0.75 / (3**0.75 + 2**0.75 + 2) + gamma / 2)


@pytest.mark.parametrize(("name", "want"), [("org/Llama-2-7b", "LLaMA"), ("x/my-7b-foobar-v2", "Foobar"), ("a/7b-chat", "Other"), (None, "Other"), ("deberta-v3", "DeBERTa")])
def test_families(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(family_by_name(F.col("n"))).first()[0] == want


def test_origins_put_guessed_quantisation_last(spark):
    rows = [("a/m-int8", None, None, None, False), ("a/m-int8", None, None, "finetune", False), ("a/m", "gguf", None, "finetune", True), ("a/m-q4", "peft", ["x"], None, False), ("a/m", None, ["LoRA"], None, False)]
    df = spark.createDataFrame(rows, "name string, library string, tags array<string>, relation string, same boolean")
    q = taxonomy.quantisation(F.lit(False), F.col("library"), F.col("tags"), F.col("name"))
    s = taxonomy.source_type(q, F.col("library"), F.col("tags"), F.col("relation"), F.lit(False), F.col("same"))
    got = [tuple(r) for r in df.select(q["method"], q["bits"], s["type"], s["confidence"]).collect()]
    assert got == [("fp8", 8, "quantized-conversion", 0.4), ("fp8", 8, "community-finetune", 0.9), ("gguf", None, "official-quantized", 0.9), ("none", None, "adapter-lora", 0.85), ("none", None, "adapter-lora", 0.85)]


def test_vocabulary_and_inversion(spark):
    t = spark.createDataFrame([(x,) for x in "aabbbccd"], "token string")
    old = spark.createDataFrame([("z", 5)], "token string, id long")
    words = vocabulary.vocabulary(t, old, 2)
    assert {r.token: r.id for r in words.collect()} == {"z": 5, "a": 6, "b": 7, "c": 8}
    assert [r.k for r in vocabulary.category_ids(t, "token", words, "k").where("token = 'd'").collect()] == [0]
    with pytest.raises(ValueError, match="two codes"):
        vocabulary.inverted(spark.createDataFrame([(1, "x"), (2, "x")], "code int, label string"))


def test_principal_axes(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 5)) * [5, 3, 1, 0.5, 0.1]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item long, v array<double>")
    mean, axes, var = vectors.principal(v, 2)
    u, s, vt = np.linalg.svd(x - x.mean(0))
    assert np.allclose(np.abs(axes), np.abs(vt[:2]), atol=1e-8) and np.allclose(var, s[:2] ** 2 / 300)
    p = np.array([r.p for r in vectors.project(v, mean, axes).orderBy("item").collect()])
    assert np.allclose(p, (x - mean) @ axes.T)


def test_scorecard_of_a_toy(spark):
    models = spark.createDataFrame([(i, i % 2, True, i > 2, "f" if i < 4 else "other", float(i)) for i in range(6)], "item long, flags int, in_snapshot boolean, licensed boolean, family string, size_b double")
    labels = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.5), (0, 4, 0.2)], "query long, item long, value double")
    got = evaluation.scorecard(spark.createDataFrame([(0, 1), (0, 5)], "query long, item long"), labels, models).first()
    assert (got.record_coverage, got.unknown, got.recorded_gold, got.available, got.median_size_b) == (0.5, 0.5, 0, 0.0, 3.0)


def test_systems_must_have_equal_queries(spark):
    a = spark.createDataFrame([(1, 3), (2, 30)], "query long, rank long")
    assert evaluation.paired(a, a.withColumn("rank", 33 - F.col("rank"))).first()[:4] == (0, 1, 1, 0)
    with pytest.raises(ValueError, match="different queries"):
        evaluation.paired(a, a.limit(1))


def test_component_count_is_brute_force(spark, sf):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        for d in (r.o_orderkey, r.o_orderkey + 5):
            a, b = find(("c", r.o_custkey)), find(("o", d))
            parent[a] = b
    got = catalog.queries()["component_count"](spark, sf).first()
    assert (got.nodes, got.components) == (len(parent), len({find(x) for x in parent}))


def test_intake_and_ladder(spark):
    rows = [("m1", "d", "t", "Accuracy", "80"), ("m2", "d", "t", "accuracy ", "90"), ("m3", "d", "t", "f1@5", "0.5"), ("m9", "d", "t", "accuracy", "70"), ("m1", "e", "t", "loss", "1"), ("m2", "d", "t", "accuracy", "n/a")]
    df = spark.createDataFrame(rows, "model string, dataset string, task string, metric string, value string")
    known = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "model string")
    got = {(r.model, r.metric): r.value_norm for r in audit.intake(df, known, ("accuracy", "f1")).collect()}
    assert got == {("m1", "accuracy"): 0.8, ("m2", "accuracy"): 0.9}
    canon = spark.createDataFrame([(2, "b", "F", "r"), (1, "z", "F", "r")], "place long, model string, family string, family_source string")
    extra = spark.createDataFrame([("y",), ("a",)], "model string")
    hist = spark.createDataFrame([("y", "H2", "s2", 2), ("y", "H1", "s1", 1)], "model string, family string, source string, priority int")
    rungs = audit.ladder(canon, extra, hist)
    assert [(r.id, r.model, r.family) for r in rungs.orderBy("id").collect()] == [(0, "z", "F"), (1, "b", "F"), (2, "a", "other"), (3, "y", "H1")]
    assert all(r.ok for r in audit.ladder_checks(rungs, canon, extra, extra).collect())
