"""Paged listings, pinned files, graphs, pools, shards and onboarding on small folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.functions.text import utc_now
from lakewright.operators import vectors
from lakewright.sources import files, paged
from lakewright.streaming import ingest


def pages(folder, *chain):
    for name, ids, following in chain:
        records = [{"id": i, "private": i.startswith("p")} for i in ids]
        (folder / name).write_text(json.dumps({"records": records, "next": following}))
    return str(folder)


def test_pages_as_table_and_stream(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    path = pages(tmp_path / "pages", ("a", ["m1", "p1"], "b"), ("b", ["m2"], "c"), ("c", ["m1", "m3"], None))
    paged.register(spark)
    read = spark.read.format("pages").option("path", path).option("start", "a").load()
    assert sorted(r.id for r in read.collect()) == ["m1", "m1", "m2", "m3"]
    stream = spark.readStream.format("pages").option("path", path).option("start", "a").load()
    query = ingest.deduplicated(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["m1", "m2", "m3"]


def test_broken_listings_raise(spark, tmp_path):
    ok = [{"id": "a", "private": False}]
    assert paged.checked(ok, "x", "y", {"w"}) == ok
    for args in ((ok, "x", "x", set()), (ok, "x", "w", {"w"}), ([], "x", "y", set()), ({}, "x", None, set()), ([{"id": " ", "private": True}], "x", None, set()), ([{"id": "a"}], "x", None, set())):
        with pytest.raises(ValueError):
            paged.checked(*args)
    path = pages(tmp_path, ("a", ["m1"], "b"), ("b", ["m2"], "a"))
    paged.register(spark)
    with pytest.raises(Exception, match="cursor repeats"):
        spark.read.format("pages").option("path", path).option("start", "a").load().collect()


def test_transient_failures_are_tried_again():
    slept, left = [], [paged.Transient("busy"), paged.Transient("limit", 7.0), paged.Transient("busy")]

    def fetch(cursor):
        if left:
            raise left.pop(0)
        return cursor

    assert paged.retrying(fetch, sleep=slept.append)("x") == "x" and slept == [2.0, 7.0, 8.0]
    left.extend([paged.Transient("busy")] * 2)
    with pytest.raises(paged.Transient):
        paged.retrying(fetch, most=1, sleep=slept.append)("x")


def test_pinned_files(spark, tmp_path):
    for n, text in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "three")):
        (tmp_path / n).write_text(text)
    pinned = spark.createDataFrame(files.inventory(spark, str(tmp_path)).collect())
    assert files.verify(pinned, files.inventory(spark, str(tmp_path))).count() == 0
    (tmp_path / "a.txt").write_text("eno")
    (tmp_path / "b.txt").write_text("longer")
    (tmp_path / "c.txt").unlink()
    (tmp_path / "d.txt").write_text("new")
    got = {r.file: r.fault for r in files.verify(pinned, files.inventory(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": "content", "b.txt": "size", "c.txt": "missing", "d.txt": "not pinned"}
    manifest = spark.createDataFrame([("a", ["full"]), ("b", ["full", "small"])], "file string, profiles array<string>")
    assert [r.file for r in files.profile(manifest, "small").collect()] == ["b"]
    with pytest.raises(ValueError):
        files.profile(manifest, "none")


def test_json_document_is_replaced_at_once(spark, tmp_path):
    path = tmp_path / "state.json"
    for value in ({"a": 1}, {"b": ["ü"]}):
        files.write_json(spark, f"file://{path}", value)
        assert json.loads(path.read_text(encoding="utf-8")) == value
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["state.json"]


def test_graph_and_pools_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, w double")
    files.save_graph({"uses": edges, "bad": edges.drop("src")}, str(tmp_path / "g"))
    assert files.read_edges(spark, str(tmp_path / "g"), "uses").collect() == edges.collect()
    with pytest.raises(ValueError):
        files.read_edges(spark, str(tmp_path / "g"), "bad")
    pools = spark.createDataFrame([(1, [7, 8], [0.9, 0.1]), (2, None, None), (3, [], [])], "query long, items array<long>, scores array<double>")
    got = files.save_pools(pools, str(tmp_path / "p")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 7, 0.9), (1, 2, 8, 0.1)]


def test_torn_shards_keep_committed_lines(spark, tmp_path):
    (tmp_path / "s0").write_text("a\nb\nc\n")
    (tmp_path / "s1").write_text('d\n{"torn')
    (tmp_path / "s2").write_text("never committed\n")
    ledger = spark.createDataFrame([("s0", 3), ("s1", 1)], "file string, lines long")
    got = files.committed_lines(spark, str(tmp_path), ledger).collect()
    assert sorted(map(tuple, got)) == [("s0", 1, "a"), ("s0", 2, "b"), ("s0", 3, "c"), ("s1", 1, "d")]


def test_onboarding_adds_each_model_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda: ingest.file_stream(spark, str(tmp_path / "in"), "id string, x double")
    go = lambda: ingest.onboard(stream(), str(tmp_path / "index"), str(tmp_path / "cp"), F.array("x", F.lit(1.0)))
    (tmp_path / "in" / "1.json").write_text('{"id":"a","x":1}\n{"id":"b","x":2}\n{"x":3}\n')
    go()
    (tmp_path / "in" / "2.json").write_text('{"id":"b","x":9}\n{"id":"c","x":4}\n')
    go()
    go()
    got = spark.read.parquet(str(tmp_path / "index")).collect()
    assert sorted((r.id, list(r.v)) for r in got) == [("a", [1.0, 1.0]), ("b", [2.0, 1.0]), ("c", [4.0, 1.0])]


def test_planted_rotation_is_found(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    x -= x.mean(0)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item long, p array<double>")
    r, det, raw, fit = vectors.align(frame(x), frame(x @ q.T))
    assert np.allclose(r, q, atol=1e-9) and abs(abs(det) - 1) < 1e-9 and fit < 1e-9 < raw
    with pytest.raises(ValueError):
        vectors.align(frame(x), frame(x[1:]))


def test_clock_has_the_named_form(spark):
    assert len(spark.range(1).select(utc_now().alias("t")).first().t) == 25
