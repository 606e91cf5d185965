"""Mixing, packing and the pipeline against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import mixing, packing
from lakewright.llm.common import word_count
from lakewright.storage import table

DOCS = "doc_id long, text string, source string"


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, float(sum(sizes.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_word_count(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc\x0c\r\nd ", "a b c", "é x", "\x1fa b"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()]
    assert got == [n_words(t) for t in texts]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 3, None: 7, "": 2}, {"z": 5}, {"a": 0, "b": 4}, {f"s{i}": (i * 37) % 91 for i in range(30)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    rows = rows.withColumn("source_key", mixing.source_key(rows))
    got = {r.source_key: r.target for r in mixing.targets(rows).collect()}
    want = brute_targets(sizes)
    assert got == {("1" if s is None else "0" + s): pytest.approx(t) for s, t in want.items()}


@pytest.mark.parametrize("bucket", [1024, 20])
def test_mix_meets_targets(spark, sf, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    docs = table(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    got = mixing.mix(docs).collect()
    assert {(r.doc_id, r.size) for r in got} == {(r.doc_id, n_words(r.text)) for r in docs.collect()}
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source_key, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_flight_keeps_sums_and_means():
    rng = np.random.default_rng(3)
    p, size = rng.uniform(0, 1, 200), rng.integers(0, 500, 200).astype(float)
    total = np.zeros(200)
    for k in range(300):
        out = mixing.flight(p, size, np.random.default_rng(k).uniform(0, 1, 200))
        assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3
        assert ((out > 0) & (out < 1)).sum() <= 2
        total += out
    assert abs(total / 300 - p).max() < 0.15


def test_mix_edge_cases(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", "x"), (2, None, "x"), (3, "", "x"), (4, "w " * 60000, "y")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", size string")
    assert mixing.mix(docs).count() == 6 and mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got, want = {}, {}
    for r in out.collect():
        got[r.doc_id, r.text, r.source] = got.get((r.doc_id, r.text, r.source), 0) + 1
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + r.copies
    assert sum(got.values()) == sum(want.values())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_repeated_rows_are_spread_over_buckets(spark, monkeypatch):
    """Rows without an id that are all alike are no hot bucket."""
    monkeypatch.setattr(mixing, "BUCKET", 50)
    seen = []
    fly = mixing._fly
    monkeypatch.setattr(mixing, "_fly", lambda rows, level, last: seen.append(rows) or fly(rows, level, last))
    docs = spark.createDataFrame([(None, "a b", "x")] * 2000 + [(1, "c " * 3000, "y")], DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == 2001 and max(r["count"] for r in seen[0].groupBy("source_key", "bucket").count().collect()) < 120
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixed_rows_are_the_mix(spark, sf):
    docs = table(spark, sf, "documents").withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")))
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert {r.doc_id: r.n for r in mixing.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want


def test_packing_is_whole_and_tight(spark, sf):
    docs = table(spark, sf, "documents")
    size = {r.doc_id: n_words(r.text) for r in docs.collect()}
    got = packing.packed(docs).collect()
    whole, bins = {}, {}
    for r in got:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_words
        bins.setdefault(r.bin_id, []).append(r)
    assert whole == size
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
        assert rows[0].bin_length == min(c for c in packing.LENGTHS if c >= at)
    assert sum(v[0].bin_length for v in bins.values()) < 1.1 * sum(size.values())


def total(bins):
    return sum(packing.cost(c) for c in bins)


def cheapest(sizes, lengths):
    """Least cost of any way to share the pieces out over bins: all set partitions."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], total(min(c for c in lengths if c >= b) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= lengths[-1]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_pack_by_brute_force():
    rng, ratios = np.random.default_rng(0), []
    for _ in range(60):
        sizes = [int(x) for x in rng.integers(1, 4097, int(rng.integers(1, 8))) // rng.integers(1, 12)] or [1]
        sizes = [max(1, x) for x in sizes]
        where, offset, bins = packing.pack(sizes)
        for b, length in enumerate(bins):
            held = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if where[i] == b)
            assert [at for at, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
            assert length == min(c for c in packing.LENGTHS if c >= sum(n for _, n in held))
        ratios.append(total(bins) / cheapest(sizes, packing.LENGTHS))
    assert min(ratios) >= 1 - 1e-9 and np.mean(ratios) < 1.05 and max(ratios) < 1.4
    assert packing.pack([], (4,)) == ([], [], []) and packing.pack([3], (4, 8)) == ([0], [0], [4])


def alone(sizes, length):
    """Cost where every size class that fits opens one length."""
    opened = [max(length, k) for k in packing.LENGTHS]
    used = packing.place(sorted(sizes, reverse=True), opened, packing.LENGTHS)[2]
    return total(min(k for k in packing.LENGTHS if k >= u) for u in used)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_pack_chooses_several_lengths_jointly(seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in np.concatenate([rng.integers(1, 250, 300), rng.integers(260, 340, 700), rng.integers(1100, 1400, 200)])]
    _, _, bins = packing.pack(sizes)
    ones = [alone(sizes, c) for c in packing.LENGTHS]
    assert total(bins) <= min(ones) and total(bins) < 0.95 * ones[-1]
    assert sum(bins.count(c) >= 0.05 * len(bins) for c in packing.LENGTHS) >= 2
    if seed < 2:  # no single length does as well
        assert total(bins) < min(ones)


def test_packing_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "w " * 10000, 1), (3, "w " * 10000, 1)], "doc_id long, text string, piece int")
    got = packing.packed(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == sorted([(1, 0), (2, 0), (0, 2)] + 2 * [(3, 4096), (3, 4096), (3, 1808)])
    assert packing.packed(docs.limit(0)).count() == 0


