"""Queries on odd rows and on more keys than the smallest tables hold: against brute force, or their SQL."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewright.llm import jaccard
from lakewright.operators import graph, retrieval
from lakewright.plans import catalog


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query's rows are its SQL's over the given tables."""

    def check(name, **frames):
        c = duckdb.connect()
        for k, df in frames.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{k}.parquet")
            c.sql(f"create view {k} as from read_parquet('{tmp_path}/{k}.parquet/*.parquet')")
        got, want = catalog.queries()[name](spark, str(tmp_path)), c.sql(catalog.oracle_sql()[name])
        order = lambda rows: sorted(map(repr, rows))
        got = got.select(*want.columns).collect()
        assert order(map(tuple, got)) == order(want.fetchall())
        return got

    return check


LINES = "l_suppkey long, l_partkey long, l_extendedprice double"


def test_contrast_pairs_on_halves_and_nulls(spark, same):
    """Means that end in a half are rounded up in any order of their sum."""
    draw, rows = random.Random(1), []
    for d in range(40):
        cents = [draw.randrange(2_000_000, 4_000_000) for _ in range(12)]
        cents[-1] += (3 - sum(cents)) % 6  # the mean is a whole number of thousandths and a half
        top = (10 * sum(cents) + 6) // 12
        rows += [(1, d, x / 100) for x in cents] + [(2, d, (top - 20_000_001) / 1000), (3, d, (top - 20_000_000) / 1000)]
    e = spark.createDataFrame(rows, LINES).groupBy(F.col("l_partkey").alias("d"), F.col("l_suppkey").alias("m"))
    e = e.agg(graph.rounded_mean(F.col("l_extendedprice"), 1000).alias("w"))
    assert {tuple(r) for r in graph.gap_pairs(e, 20_000_000).collect()} == {(d, 1) for d in range(40)}
    odd = [(1, None, 1.0), (2, None, 90_000.0), (1, 3, None), (2, 3, 90_000.0), (4, 3, 1.0), (None, 3, 2.0), (1, 5, 0.123456789)]
    same("contrast_pairs", lineitem=spark.createDataFrame(odd, LINES))


def test_co_members_of_few_and_many_groups(spark, same, monkeypatch):
    draw = random.Random(2)
    rows = [(m, draw.randrange(50), 1.0) for m in range(300) for _ in range(draw.randrange(1, 4))]
    rows += [(None, 1, 1.0), (400, None, 1.0), (401, 7, 1.0), (402, -3, 1.0)] + [(m, 9, 1.0) for m in range(500, 540)]
    lines = spark.createDataFrame(rows, LINES)
    same("co_members", lineitem=lines)
    monkeypatch.setattr(graph, "SIGNATURES", 40)
    same("co_members", lineitem=lines)
    pairs = [(m, draw.randrange(400)) for m in range(200) for _ in range(3)]  # more groups than a word has bits
    of = {m: {d for n, d in pairs if n == m} for m in range(200)}
    want = {m: sum(bool(s & t) for n, t in of.items() if n != m) for m, s in of.items()}
    got = dict(map(tuple, graph.peers(spark.createDataFrame(pairs, "m long, d long")).collect()))
    assert got == {m: n for m, n in want.items() if n}


SEARCHES = "exact_top_k", "recall_of_rounded", "hub_corrected", "hard_negatives"
VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, width=6):
    draw = random.Random(n)
    rows = [(i, [float(draw.randrange(-9, 10)) / 8 for _ in range(width)], i % 3) for i in range(n)]
    return rows + [(n + i, rows[i][1], 0) for i in range(0, 40)]  # equal vectors tie


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_keep_no_pairs(spark, same, monkeypatch, name):
    """Lists over several blocks of queries and batches of items, and no pair of all of them scored in rows."""
    def pairs(*_):
        raise AssertionError("all pairs are made as rows")

    monkeypatch.setattr(retrieval, "scores", pairs)
    monkeypatch.setattr(retrieval, "QUERIES", 9)
    monkeypatch.setattr(retrieval, "PART", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        same(name, embeddings=spark.createDataFrame(vectors(400), VECTORS))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_of_odd_vectors(spark, same, name):
    """Null vectors come last, not-a-number first; few items make short lists."""
    rows = vectors(40)[:30]
    rows[3], rows[20], rows[7], rows[8] = (3, None, 1), (20, None, 1), (7, [float("nan")] * 6, 0), (8, [float("inf")] + [1.0] * 5, 0)
    same(name, embeddings=spark.createDataFrame(rows, VECTORS))
    same(name, embeddings=spark.createDataFrame([(0, None, 0), (20, None, 0), (21, [1.0], 0)], VECTORS))


def test_jaccard_sends_sets_only_to_likely_partners(spark, monkeypatch):
    """A long chain of documents that overlap without a link is one group of many blocks: no set goes to all of them."""
    sent = []

    def counted(df, name, cut=jaccard.cut):
        out = cut(df, name)
        if name == "told":
            sent.append(out.agg(F.sum(F.size("to"))).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    for name, value in (("BLOCK", 400), ("SOUGHT", 800)):
        monkeypatch.setattr(jaccard, name, value)
    rows = [(i, " ".join(f"w{j}" for j in range(16 * i, 16 * i + 102))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 300, 3)]
    got = {tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {(i, 100, i) for i in range(300)} | {(1000 + i, 101, i) for i in range(0, 300, 3)}
    assert sent and max(sent) <= 4 * len(rows)


def test_jaccard_sends_no_set_of_a_common_passage_to_every_block(spark, monkeypatch):
    """Documents with one long passage and tails of their own are one group of frequent shingles: few are likely to link."""
    sent = []

    def counted(df, name, cut=jaccard.cut):
        out = cut(df, name)
        if name == "told":
            sent.append(out.agg(F.sum(F.size("to"))).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    for name, value in (("BLOCK", 400), ("SOUGHT", 800), ("FREQUENT", 5), ("COMPARED", 400)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    passage = " ".join(f"p{j}" for j in range(82))
    rows = [(i, passage + "".join(f" w{i}x{j}" for j in range(20))) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 200, 4)]
    rows += [(2000 + i, rows[i][1] + " and its end") for i in range(0, 200, 8)]
    got = {tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {(d, 100 + (d >= 1000) + 2 * (d >= 2000), d % 1000) for d, _ in rows}
    assert sent and max(sent) <= 4 * len(rows)


@pytest.mark.parametrize("num", [30, 80, 90])
def test_likely_pairs_lose_no_link(num):
    """Against all pairs: every link between labels is likely, and of each row the nearest is kept."""
    draw = np.random.default_rng(num)
    base, sets = draw.integers(0, 2**63, 900, dtype=np.uint64), []
    for i in range(150):
        n = int(draw.integers(1, 200)) if i % 3 else int(draw.integers(200, 900))
        sets.append(np.unique(np.concatenate([base[:n], draw.integers(0, 2**63, int(draw.integers(0, 9)), dtype=np.uint64)])))
    rows = pd.DataFrame({"doc_id": range(150), "label": [i // 2 for i in range(150)], "main": 3, "n": [len(s) for s in sets]})
    rows["sketch"] = [jaccard.sketch(s) for s in sets]
    left = rows[rows["label"] != 3].iloc[::2].reset_index(drop=True)

    def linked(i, j):
        a, b = sets[left["doc_id"][i]], sets[j]
        same = len(np.intersect1d(a, b))
        return left["label"][i] != rows["label"][j] and 100 * same >= num * (len(a) + len(b) - same)

    links = {(i, j) for i in range(len(left)) for j in range(150) if linked(i, j)}
    pairs = jaccard.likely_pairs(left, rows, num, 100, False)
    one_way = {(i, j) for i, j in links if rows["label"][j] == 3 or left["doc_id"][i] < j}
    assert one_way and one_way <= set(zip(pairs["i"], pairs["j"], strict=True))
    near = jaccard.likely_pairs(left, rows, num, 100, True)
    assert near["i"].is_unique and {i for i, _ in links} <= set(near["i"])
    least = pairs.groupby("i")["d"].min()
    assert (near.set_index("i")["d"].reindex(least.index) <= least).all()
    assert not len(jaccard.likely_pairs(left.iloc[:0], rows, num, 100, True)) and not len(jaccard.likely_pairs(left, rows.iloc[:0], num, 100, False))


def test_sketches_never_exceed_the_difference(spark):
    draw = np.random.default_rng(3)
    rows = []
    for n in (1, 3, 60, 64, 65, 130, 1000, 20_000):
        a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 9], draw.integers(0, 2**63, n // 7, dtype=np.uint64)]))
        rows.append((len(np.setxor1d(a, b)), jaccard.sketch(a).tolist(), jaccard.sketch(b).tolist()))
    df = spark.createDataFrame(rows, "d long, a array<long>, b array<long>")
    got = df.select("d", jaccard.differ(F.col("a"), F.col("b")).alias("x"), jaccard.differ(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(0 <= r.x <= r.d and r.x == r.y for r in got) and sum(r.x for r in got) > 0.5 * sum(r.d for r in got)
