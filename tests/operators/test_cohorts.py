"""Cohort operators against planted cases and brute force."""

import itertools

import numpy as np
import pytest

from lakewright.operators import cohorts


def test_separability_finds_planted_classes_and_only_those(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + [3.0 * (i % 2), 0, 0, 0]).tolist(), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "item long, v array<double>, y int")
    got = {r.slice: r.auc for r in cohorts.separability(df, {"told": (0, 1), "noise": (1, 4)}).collect()}
    assert got["told"] > 0.95 and abs(got["noise"] - 0.5) < 0.12
    with pytest.raises(ValueError):
        cohorts.separability(df.where("y = 0"), {"told": (0, 1)})


def test_pair_cosine_is_the_mean_over_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    rows = [(i % 3, v.tolist()) for i, v in enumerate(x)] + [(7, [1.0] * 5), (0, None), (0, [0.0] * 5), (1, [float("nan")] * 5)]
    got = {r.g: r for r in cohorts.pair_cosine(spark.createDataFrame(rows, "g int, v array<double>"), ["g"]).collect()}
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    for g in range(3):
        some = z[g::3]
        want = np.mean([a @ b for a, b in itertools.combinations(some, 2)])
        assert abs(got[g].mean_cos - want) < 1e-12 and got[g].n == 10 and got[g].pairs == 45
    assert got[7].mean_cos is None and got[7].pairs == 0


def test_repairs_of_another_graph_raise(spark):
    vocabulary = spark.createDataFrame([("Other", 0), ("qa", 1), ("ner", 2)], "token string, id long")
    old = vocabulary.where("id < 2")
    nodes = spark.createDataFrame([(1, 0), (2, 1)], "id long, task_id long")
    patch = lambda *rows: spark.createDataFrame(rows, "id long, action string, task_id long")
    use = "replace_Other_after_review"
    good = cohorts.repair_tasks(nodes, patch((1, use, 2), (2, "keep", 2)), old, vocabulary)
    assert sorted(map(tuple, good.select("id", "task_id").collect())) == [(1, 2), (2, 1)]
    for bad in (patch((2, use, 2)), patch((9, use, 2)), patch((1, use, 5)), patch((1, use, 2), (1, use, 1))):
        with pytest.raises(ValueError):
            cohorts.repair_tasks(nodes, bad, old, vocabulary)
    for words in ([("Other", 0), ("qa", 2)], [("qa", 0), ("Other", 1)], [("Other", 0), ("ner", 1), ("qa", 2)]):
        with pytest.raises(ValueError):
            cohorts.repair_tasks(nodes, patch((1, use, 1)), old, spark.createDataFrame(words, "token string, id long"))


def test_ids_must_be_one_to_one(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    ids = lambda *rows: spark.createDataFrame(rows, "id long, task long")
    assert cohorts.attach_ids(nodes, ids((1, 5), (2, 6), (3, 7)), "id", "task").count() == 2
    for bad in (ids((1, 5)), ids((1, 5), (2, 6), (2, 7))):
        with pytest.raises(ValueError):
            cohorts.attach_ids(nodes, bad, "id", "task")


def test_cards_by_id_name_and_parent(spark):
    cards = spark.createDataFrame([("glue",), ("a/squad",), ("a/dup",), ("b/dup",), ("up/solo",), (None,)], "id string")
    names = {
        "GLUE ": ("hf_card", "glue"), "squad": ("hf_card", "a/squad"), "dup": ("name_only_ambiguous", None), "nothing": ("name_only", None),
        "a/squad": ("hf_card", "a/squad"), "c/squad": ("name_only_cross_owner_rejected", None), "glue/sst2": ("hf_card_via_parent", "glue"),
        "solo/x": ("hf_card_via_parent", "up/solo"), "dup/x": ("name_only", None), "glue/dup": ("hf_card_via_parent", "glue"),
    }
    got = cohorts.match_cards(spark.createDataFrame([(n, "t") for n in names], "dataset string, id string"), cards)
    assert {r.dataset: (r.card_source, r.matched_id) for r in got.collect()} == names
    assert got.columns == ["dataset", "id", "card_source", "matched_id"]


def test_strata_of_an_empty_table_have_no_row(spark):
    gold = spark.createDataFrame([], "query string, item long, task string, rank long")
    visible = spark.createDataFrame([], "item long, dataset long, task string")
    assert cohorts.cold_start(gold, visible).count() == 0
