"""Operators on toy fixtures with hand-computed results."""

import json

import pytest
from pyspark.sql import functions as F

from lakewright.functions import metrics, text, vector
from lakewright.operators import checks, evidence, graph, prior, ranking, retrieval, taxonomy
from lakewright.sources import records
from lakewright.streaming import ingest

OBS = "model string, dataset string, task string, metric string, value double"


def weights(spark, rows):
    w = evidence.weighted(evidence.dedupe_median(spark.createDataFrame(rows, OBS)))
    return {(r.model, r.metric): r.weight for r in w.collect()}


def test_median_dedupe_and_orientation(spark):
    got = evidence.dedupe_median(spark.createDataFrame([("m1", "d", "t", "accuracy", v) for v in (0.1, 0.5, 0.9)], OBS)).first()
    assert (got.value, got.n_records) == (0.5, 3)
    assert weights(spark, [("good", "d", "t", "wer", 0.05), ("mid", "d", "t", "wer", 0.3), ("bad", "d", "t", "wer", 0.9)]) == {("good", "wer"): 1.0, ("mid", "wer"): pytest.approx(0.70588, abs=1e-4), ("bad", "wer"): 0.0}
    assert set(weights(spark, [("a", "d", "t", "f1", 0.7), ("b", "d", "t", "f1", 0.7)]).values()) == {0.5}
    assert weights(spark, [("a", "d", "t", "ndcg_at_1", 0.1), ("b", "d", "t", "ndcg_at_1", 0.2), ("a", "d", "t", "ndcg_at_10", 0.8), ("b", "d", "t", "ndcg_at_10", 0.9)]) == {("a", "ndcg_at_1"): 0, ("b", "ndcg_at_1"): 1, ("a", "ndcg_at_10"): 0, ("b", "ndcg_at_10"): 1}


@pytest.mark.parametrize(("dataset", "metric", "n", "eligible"), [("d", "accuracy", 3, True), ("d", "mystery", 4, False), ("d", "mean_reward", 5, False), ("unknown", "accuracy", 5, False), ("d", "accuracy", 2, False)])
def test_eligibility(spark, dataset, metric, n, eligible):
    df = spark.createDataFrame([(f"m{i}", dataset, "t", metric, i / 10) for i in range(n)], OBS)
    node = evidence.nodes(evidence.primary_edges(evidence.weighted(evidence.dedupe_median(df)))).first()
    assert (node.n_models, node.gold_eligible) == (n, eligible)


def test_primary_metric_prefers_known_direction(spark):
    rows = [(f"m{i}", "d", "t", "some_custom", i / 10) for i in range(5)] + [(f"m{i}", "d", "t", "accuracy", i / 10) for i in range(3)]
    assert evidence.primary_metric(evidence.weighted(spark.createDataFrame([(*r, 1) for r in rows], OBS + ", n_records int"))).first().metric == "accuracy"


def test_cap_keeps_the_range_and_is_deterministic(spark):
    rows = [(f"m{i}", "d", "t", i / 500) for i in range(500)]
    df = spark.createDataFrame(rows, "model string, dataset string, task string, weight double")
    a = sorted(r.model for r in evidence.stratified_cap(df, 50).collect())
    b = evidence.stratified_cap(df.repartition(7), 50)
    assert a == sorted(r.model for r in b.collect()) and len(a) == 50
    s = b.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).first()
    assert s.lo < 0.1 and s.hi > 0.9


@pytest.mark.parametrize(("raw", "want"), [("0.3", 0.3), (" 88% ", 88.0), ("[0.3]", 0.3), ("11.05 +/- 5.90", None), ("n/a", None), ("", None), (None, None), ("true", None), ("NaN", None), ("inf", None), ("{}", None), ("[1, 2]", None)])
def test_tolerant_number(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(text.number(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("Accuracy", "higher"), ("ndcg@10", "higher"), ("cosine_pearson", "higher"), ("WER", "lower"), ("eval loss", "lower"), ("mean_reward", "reward"), ("nauc_map", "unknown"), ("accuracy_std", "unknown"), ("", "unknown"), (None, "unknown")])
def test_direction(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(metrics.direction(F.col("x"))).first()[0] == want


def test_hashes_and_tie_keys(spark):
    assert spark.range(1).select(text.md5_bucket(F.lit("bert"))).first()[0] == 1008
    got = [int(r[0]) for r in spark.range(5).select(text.tie_key(F.col("id"))).collect()]
    assert got == [(i * 11400714819323198485 + 15111065706836454659) % 2**64 for i in range(5)]


def test_prior_and_leave_one_out(spark):
    e = spark.createDataFrame([("t", "a", "d1", 1.0), ("t", "a", "d2", 0.5), ("t", "b", "d1", 0.0)], "task string, model string, dataset string, weight double")
    got = {(r.task, r.model): r.prior for r in prior.priors(e, [["task", "model"], []]).collect()}
    assert got == {("t", "a"): pytest.approx(4 / 7), ("t", "b"): pytest.approx(2.5 / 6), (None, None): pytest.approx(4 / 8)}
    loo = {(r.model, r.dataset): (r.prior, r.others) for r in prior.leave_one_out(e, ["task", "model"], ["dataset"]).collect()}
    assert loo[("a", "d1")] == (pytest.approx(3 / 6), 1) and loo[("b", "d1")] == (pytest.approx(0.5), 0)


def test_split_is_disjoint_and_covers(spark):
    sizes = spark.createDataFrame([(f"r{i}", i + 1) for i in range(30)], "root string, n long")
    got = {r.root: r.side for r in prior.split_roots(sizes, 3).collect()}
    assert len(got) == 30 and set(got.values()) == {"test", "val", "train"}
    assert got != {r.root: r.side for r in prior.split_roots(sizes, 4).collect()}


def test_rerank_ranks_and_ties(spark):
    pool = spark.createDataFrame([(0, i, s) for i, s in enumerate((0.9, 0.8, 0.7, 0.6))], "query long, item long, score double")
    pri = spark.createDataFrame([(0, 3, 1.0)], "query long, item long, prior double")
    assert retrieval.fuse(pool, pri, ["query", "item"]).where("rank = 1").first().item == 3
    zeros = spark.range(100).select(F.col("id").alias("item"), F.array(F.lit(0.0)).alias("v"))
    q = spark.createDataFrame([(0, [1.0])], "query long, q array<double>")
    probe = zeros.orderBy(text.tie_key(F.col("item")).desc()).limit(1).select(F.lit(0).cast("long").alias("query"), "item")
    assert retrieval.full_ranks(q, zeros, probe).first()["rank"] == 1 and retrieval.full_ranks(q, zeros, probe, tie_break=True).first()["rank"] == 100


def test_ndcg_calibration_and_correlations(spark):
    s = spark.createDataFrame([(1, 0, 0.9, 1.0), (1, 1, 0.8, 0.99), (1, 4, 0.5, 0.1), (2, 0, 0.5, 0.7), (2, 1, 0.4, 0.7)], "query long, item long, score double, value double")
    assert {r.query: r.ndcg for r in ranking.ndcg(s).collect()} == {1: 1.0, 2: 1.0}
    assert {r.query: r.tau for r in ranking.kendall(s).collect()} == {1: 1.0, 2: None}
    assert {r.query: r.rho and round(r.rho, 9) for r in ranking.spearman(s).collect()} == {1: 1.0, 2: None}
    p = spark.createDataFrame([(0.1, 0.0), (0.9, 1.0)], "p double, y double")
    assert ranking.calibration(p, 2).agg(F.sum("gap_share")).first()[0] == pytest.approx(0.1)


def test_lineage_by_name(spark):
    names = spark.createDataFrame([("a/model",), ("a/model-GGUF",), ("a/model-q4_k_m-gguf",), ("b/model-gguf",), ("xy-gguf",)], "name string")
    assert {(r.name, r.base) for r in graph.lineage_by_name(names).collect()} == {("a/model-GGUF", "a/model"), ("a/model-q4_k_m-gguf", "a/model")}


def test_taxonomy_cascades(spark):
    df = spark.createDataFrame([("org/Foo-7B-GGUF", ["en", "fr"], 0.05), ("org/7b-gguf", [], None), ("org/bar-int8", ["de"], 95.0)], "name string, codes array<string>, size double")
    quant = taxonomy.quantisation(F.lit(False), F.lit(None).cast("string"), F.array().cast("array<string>"), F.col("name"))
    bucket = taxonomy.language_bucket(F.col("codes"), F.lit("image-generation"))
    got = [tuple(r) for r in df.select(taxonomy.repo_stem(F.col("name")), quant["method"], quant["bits"], bucket, taxonomy.scale_bucket(F.col("size"))).collect()]
    assert got == [("foo", "gguf", None, "multilingual-with-english", "<0.1B"), ("7b-gguf", "gguf", None, "language-neutral", "unknown"), ("bar", "fp8", 8, "non-english", ">=90B")]


def test_checks_find_tampering(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "z")], "k int, v string")
    assert tuple(checks.differences(a, b).first()) == (1, 1)
    assert checks.digest(a).first() == checks.digest(a.repartition(3)).first() != checks.digest(b).first()


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    assert df.select(vector.norm(F.col("v"))).first()[0] == 5.0
    assert df.select(vector.masked(F.col("v"), (1,))).first()[0] == [3.0, 0.0]


def test_json_records_and_manifest(spark, tmp_path):
    index = json.dumps([{"task": "text-classification", "dataset": "org/ds", "metrics": [{"type": "accuracy", "value": 0.9}]}, {"task": "x", "metrics": [{"type": "f1", "value": 1}]}, {"task": "x", "dataset": "d", "metrics": []}])
    lines = [json.dumps({"id": " A/B ", "tags": ["t"], "cardData": {"model-index": index, "base_model": ["p"]}}), "not json", json.dumps({"id": "c", "cardData": {"model-index": "oops"}})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(lines))
    got = records.read_jsonl(spark, f"file://{tmp_path}/in")
    assert [tuple(r) for r in records.claims(got, F.col("cardData.`model-index`")).collect()] == [("a/b", "org/ds", "text-classification", "accuracy", 0.9)]
    made = records.write_with_manifest(spark.range(10), f"file://{tmp_path}/out").collect()
    assert sum(r["rows"] for r in made) == 10 and all(len(r.sha256) == 64 for r in made)


def test_ingest_resumes_and_keeps_one_row_an_id(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text('{"id": "a"}\n{"id": "b"}\n{"id": "a"}\n')
    go = lambda: ingest.run_once(ingest.deduplicated(ingest.file_stream(spark, f"file://{src}", "id string")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    go()
    (src / "2.json").write_text('{"id": "b"}\n{"id": "c"}\n')
    go()
    go()
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_random_baseline_takes_the_real_pool(spark, tmp_path):
    from lakewright.plans import catalog

    n = 1200
    rows = [(i, [1.0, float(i)], i % 2) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    chances = []
    for q in range(0, n, 20):
        values = [(q * 7919 + i * 104729) % 101 / 100.0 for i in range(n) if i % 2 == q % 2 and i != q]
        near, miss = sum(v >= max(values) - 0.01 for v in values), 1.0
        for j in range(10):
            miss *= (n - near - j) / (n - j)
        chances.append(1 - miss)
    got = catalog.queries()["random_baseline"](spark, str(tmp_path)).first()
    assert got.gap_10 == round(sum(chances) / len(chances), 6)
