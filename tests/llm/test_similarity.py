"""Jaccard join, fingerprints and nearest neighbours against brute force."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import ann, fingerprints, jaccard
from lakewright.storage import table

DOCS = "doc_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b) and None not in (rows[i][0], rows[j][0]):
            x, y = sorted((find(rows[i][0]), find(rows[j][0])))
            parent[y] = x
    return {(d, len(s), find(d) if s else d) for (d, _), s in zip(rows, sets)}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_is_brute_force_on_documents(spark, sf, n, num):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in jaccard.jaccard_components(docs, n, num, 100).collect()}
    assert got == brute(rows, n, num, 100)


@pytest.mark.parametrize(("block", "few", "frequent"), [(200_000, 500_000, 20), (60, 0, 2)])
def test_jaccard_on_families_of_near_copies(spark, monkeypatch, block, few, frequent):
    """Small blocks force the search across blocks, small bounds the joins that don't broadcast and frequent shingles."""
    for name, value in (("BLOCK", block), ("SOUGHT", 2 * block), ("FEW", few), ("FREQUENT", frequent), ("PIVOTS", 2), ("ASKING", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rng, rows = np.random.default_rng(1), []
    for family in range(8):
        base = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(8, 60)))]
        for _ in range(9):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 4))):
                copy[at] = f"v{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    got = {tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)
    assert len({r[2] for r in got}) < len(rows)


def test_jaccard_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É a"), (8, "é a"), (None, "one"), (9, "a b c d"), (9, "a b c d"), (10, "x " * 50000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS + ", component_id string, node int")
    got = [tuple(r) for r in jaccard.jaccard_components(docs, 3, 90, 100).collect()]
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 8), (None, 1, 4), (9, 2, 9), (9, 2, 9), (10, 1, 10)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert jaccard.jaccard_components(docs.limit(0), 3, 90, 100).count() == 0


@pytest.mark.parametrize(("n", "num"), [(1, 30), (2, 55), (1, 100)])
def test_jaccard_of_any_threshold(spark, n, num):
    rng = np.random.default_rng(num)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, int(rng.integers(1, 30))))) for i in range(120)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:5])]
    got = {tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), n, num, 100).collect()}
    assert got == brute(rows, n, num, 100)


def test_jaccard_takes_no_threshold_out_of_range(spark):
    for num in (0, 101):
        with pytest.raises(ValueError, match="least Jaccard"):
            jaccard.jaccard_components(spark.createDataFrame([], DOCS), 3, num, 100)


def test_prefixes_of_linked_sets_share_enough():
    rng = np.random.default_rng(7)
    for num in (30, 50, 80, 90, 95, 100):
        for _ in range(300):
            a = np.unique(rng.integers(0, 2**40, int(rng.integers(1, 80))).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**40, int(rng.integers(0, 6))).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if not same or 100 * same < num * len(np.union1d(a, b)) or np.array_equal(a, b):
                continue
            for times in jaccard.MORE:
                met = len(np.intersect1d(*(s[: jaccard.prefix_length(len(s), num, 100, times)] for s in (a, b))))
                for s in (a, b):
                    small = -(-len(s) * num // 100)
                    assert met >= max(1, min(-(-small * num // 100), times * small * (100 - num) // 100))


def test_divide_skip_finds_what_brute_force_finds():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2**60, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([common[: rng.integers(20, 41)], rng.integers(0, 2**60, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(80)]
    block = jaccard.Block(sets)
    for i, q in enumerate(sets):
        skip = np.arange(len(sets)) == i
        want = {j for j, s in enumerate(sets) if j != i and 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))}
        assert set(block.search(q, 80, 100, skip).tolist()) == want


def edits(spark, rows):
    """(doc_id, n_chars, digest) by a sort of all rows on one machine; ties go by Spark's hash, then by text."""
    texts = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string")
    h = {r.t: r.h for r in texts.select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]], r[1] or ""))
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        yield d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()


def test_edited_texts_are_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = fingerprints.with_edits(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edits(spark, rows))
    texts = dict(rows)
    for a, b in zip(got, got[1:]):
        assert (texts[a.doc_id] == texts[b.doc_id]) <= (a.fingerprint == b.fingerprint)
    assert np.mean([r.near_edited for r in got]) > 0.5 > 0.2 > np.median([r.near_next for r in got])


EDGES = [(3, None), (None, "x"), (2, ""), (3, "é" * 9), (2, ""), (7, "z" * 100000), (-(2**63), "least"), (2**63 - 1, "most")]


@pytest.mark.parametrize("rows", [[], [(1, "a\nb")], EDGES, EDGES * 3, [(None, f"n{i}") for i in range(9)] + [(5, "same")] * 30])
def test_edited_texts_edge_cases(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "RANGE", 5)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", range string")
    got = fingerprints.with_edits(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, edits(spark, rows) if rows else []))


def test_edited_texts_in_thousands_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 10)
    rows = [(i * 7 % 5003, f"text {i}\nline {i % 7}") for i in range(5003)]
    frame = spark.createDataFrame(rows, DOCS)
    ranges = fingerprints.in_ranges(frame)
    assert ranges.select("range").distinct().count() >= 5000
    monkeypatch.setattr(fingerprints, "in_ranges", lambda docs: ranges.coalesce(8))
    got = fingerprints.with_edits(frame).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edits(spark, rows))


def test_fingerprints_are_homomorphic():
    a, b = "one line\nanother line", "a third\n\nfourth"
    whole = fingerprints.vector(a + "\n" + b)
    both = fingerprints.merge(fingerprints.vector(a), fingerprints.vector(b))
    assert fingerprints.encode(whole) == fingerprints.encode(both) == fingerprints.encode(fingerprints.vector("fourth\nanother line\n\na third\none line"))
    assert fingerprints.encode(fingerprints.merge(whole, fingerprints.vector(b), -1)) == fingerprints.encode(fingerprints.vector(a))
    assert fingerprints.likeness(*map(fingerprints.decode, (fingerprints.encode(whole),) * 2)) == 1.0
    assert fingerprints.encode(fingerprints.vector(None)) == fingerprints.encode(fingerprints.vector(""))


def test_likeness_is_a_function_of_the_strings():
    wide = (np.zeros(64, np.uint16), np.arange(256, dtype=np.int64) * (1 << 20))
    other = (np.ones(64, np.uint16), np.arange(256, dtype=np.int64) ** 2)
    read = [fingerprints.decode(fingerprints.encode(v)) for v in (wide, other)]
    assert fingerprints.likeness(wide, other) == fingerprints.likeness(*read)


def exact(vectors, k):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    for i, v in vectors:
        if i % 20 == 0:
            s = x @ v
            keep = np.flatnonzero(ids != i)
            for rank, j in enumerate(keep[np.lexsort((ids[keep], -s[keep]))[:k]], 1):
                yield i, rank, int(ids[j]), float(s[j])


def recall(data, got):
    """Share of the exact neighbours that were found; scores are checked on the way."""
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in data.collect()]
    want = {}
    for q, _, i, s in exact(vectors, 20):
        want.setdefault(q, {})[i] = s
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert found.keys() == want.keys() and all(sorted(x.rank for x in v) == list(range(1, 21)) for v in found.values())
    known = dict(vectors)
    assert all(abs(r.score - known[r.query_id] @ known[r.vec_id]) < 1e-12 for r in got)
    return np.mean([r.vec_id in want[r.query_id] for r in got])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_nearest_neighbours_recall(spark, sf):
    data = table(spark, sf, "embeddings")
    assert recall(data, ann.search(data, lambda i: i % 20 == 0).collect()) >= 0.9


@pytest.mark.parametrize("clusters", [0, 40])
def test_nearest_neighbours_recall_of_the_index(spark, clusters):
    """Many times FIRST rows at the default parameters, with and without clusters: most rows come from the lists."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((8000, 32))
    if clusters:
        x = 0.3 * x + rng.standard_normal((clusters, 32))[rng.integers(0, clusters, len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(x) > 10 * ann.FIRST
    share = ann.sampled_share(x, ann.centres(x, 89), 20, ann.TARGET)
    assert share < (0.2 if clusters else 0.8)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(data, ann.search(data, lambda i: i % 20 == 0).collect()) >= 0.9


def test_nearest_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (20, [2.0, 2.0]), (8, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0])]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, v string")
    got = sorted(tuple(r) for r in ann.search(data, lambda i: i % 20 == 0).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 7, 1.0), (0, 3, 8, 1.0), (20, 1, 7, 4.0), (20, 2, 8, 4.0), (20, 3, 0, 2.0)]
    assert ann.search(data.limit(0), lambda i: i % 20 == 0).count() == 0


def test_scan_abandons_but_keeps_the_best():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64)) * rng.uniform(0.5, 2, (3000, 1))
    turn, ids = ann.rotation(64), np.arange(3000)
    assert np.allclose(turn @ turn.T, np.eye(64))
    xr = x @ turn
    hits = 0
    q = x[:40]
    bound = np.sort(x[:500] @ q.T, axis=0)[-20]
    got = ann.scan(q, q @ turn, bound, np.full(40, -1), x, xr, ids, 20)
    for j in range(40):
        hits += len({i for at, i, _ in got if at == j} & set(np.argsort(-(x @ q[j]))[:20].tolist()))
    assert hits / 800 > 0.97


def test_nearest_neighbours_by_lists_chunks_and_blocks(spark, monkeypatch):
    """Equal vectors tie to the smaller id wherever they lie; every row is found when all lists are visited."""
    for name, value in (("FIRST", 50), ("GROWTH", 3), ("CHUNK", 40), ("TOGETHER", 4)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 24)) * rng.uniform(0.5, 2, (700, 1))
    x[100:400] = x[100]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(data, lambda i: i % 20 == 0, share=1.0).collect())
    want = []
    for i in range(0, 700, 20):
        s = np.cumsum(x * x[i], axis=1)[:, -1]
        order = [int(j) for j in np.lexsort((np.arange(700), -s)) if j != i][:20]
        want += [(i, r, j) for r, j in enumerate(order, 1)]
    assert len(got) == len(want)
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) >= 0.97
