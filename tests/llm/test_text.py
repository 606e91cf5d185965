"""Licences, chat, WARC, language and quality on small fixtures."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import catalog, chat, language, licenses, quality, warc
from lakewright.storage import table


def test_licences_by_brute_force(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, mit[0]), (2, "Some text.\n" + mit[1].upper() + "\nmore"), (3, None), (4, ""), (5, "license"), (6, "nothing here at all"), (7, "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files (the Software), to deal in the Software without restriction\n\nOther paragraph"), (1, mit[0]), (8, ("word " * 60000) + "\nLicensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].license for i in range(1, 9)] == ["MIT", "MIT", None, None, None, None, "MIT", "CC-BY-NC-4.0"]
    assert got[1].license_dice == 1.0 and got[3].license_dice == 0.0
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
    # a tie goes to the first licence by id; very long texts with repeated notices
    tied = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "other words here\n" * 40_000 + "alpha beta gamma delta")], "doc_id long, text string")
    same = {"B": ("alpha beta gamma delta",), "A": ("alpha beta gamma delta",)}
    assert {(r.license, r.license_dice) for r in licenses.scan(tied, same).collect()} == {("A", 1.0)}

    def dice(a, b):
        return 2 * len(a & b) / (len(a) + len(b))

    line = "Released under the famous MIT License now"
    want = max(dice(set(licenses.bigrams(line)), set(b)) for _, b in licenses.templates(licenses.TEMPLATES))
    one = spark.createDataFrame([(1, line)], "doc_id long, text string")
    assert licenses.scan(one, threshold=0.5).first().license_dice == pytest.approx(want)


def test_licences_in_longer_lines_wrapped_lines_and_whole_texts(spark):
    prose = "some other words of a read me file that has no notice at all "
    mit = licenses.TEXTS["MIT"]
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    rows = [
        (1, "This project is released under the MIT License."),
        (2, "Licensed under the MIT License."),
        (3, f"{prose * 4}\nCopyright (c) 2020 A. Person\n{mit}\n{prose * 30}"),
        (4, f"{prose * 9}{mpl} {prose * 9}"),
        (5, f"{prose * 300}released\nunder the\nMIT license {prose * 300}"),
        (6, prose * 300),
        (7, f"{licenses.TEXTS['BSD-2-Clause']}\n{prose * 40}"),
    ]
    got = {r.doc_id: (r.license, r.license_dice) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["MIT", "MIT", "MIT", "MPL-2.0", "MIT", None, "BSD-2-Clause"]
    assert [got[i][1] for i in (1, 2, 3, 5, 7)] == [1.0] * 5


def test_licence_windows_by_brute_force(spark):
    rnd, t = random.Random(5), 0.7
    given = {"A": ("a b c d a b e f",), "B": ("c d e g g h a b c d i",)}
    known = licenses.templates(given)
    texts = [" ".join(rnd.choice("abcdefghixyz") for _ in range(30)) for _ in range(60)]
    texts += [" ".join([*x.split()[:12], *"a b c x d a b e f".split(), *x.split()[12:]]) for x in texts[:20]]
    got = {r.doc_id: {(round(h.dice, 9), h.license) for h in r.license_hits} for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), given, t).collect()}
    seen = 0
    for i, text in enumerate(texts):
        words, want = text.split(), set()
        for (name, b), length in zip(known, licenses.spans(given), strict=True):
            sets = [set(licenses.bigrams(" ".join(words[x : x + n + 1]))) for x in range(len(words)) for n in range(1, int(length * (2 - t) / t + 1e-9) + 1) if x + n < len(words)]
            best = max(2 * len(a & set(b)) / (len(a) + len(b)) for a in sets)
            if best >= t:
                want.add((round(best, 9), name))
        assert got[i] == want
        seen += len(want)
    assert seen >= 20


def test_branches_are_ranked_and_formatted(spark):
    # 1 -> 2 -> 4; 1 -> 3; 5 alone; a cycle 8 <-> 9; in tree null: 1 -> 2
    nodes = [("a", 1, None, 1.0, "user", "q"), ("a", 2, 1, 2.0, "assistant", "x<"), ("a", 4, 2, 9.0, "user", None), ("a", 3, 1, 3.0, "assistant", "\\>#"), ("a", 5, 77, 0.0, None, ""), ("a", 8, 9, 1.0, "u", "t"), ("a", 9, 8, 1.0, "u", "t"), (None, 1, None, 1.0, "user", "n"), (None, 2, 1, 1.0, "assistant", "m")]
    df = spark.createDataFrame([(*n, 1) for n in nodes], "tree_id string, node_id long, parent_id long, score double, role string, text string, path int")
    got = {(r.tree_id, r.leaf_id): r for r in chat.paths(df).collect()}
    assert {k: (r.path, r["rank"]) for k, r in got.items()} == {("a", 4): ([1, 2, 4], 1), ("a", 3): ([1, 3], 2), ("a", 5): ([5], 3), (None, 2): ([1, 2], 1)}
    assert {r.leaf_id for r in chat.paths(df, best=1).collect()} == {4, 2}
    made = {r.leaf_id: r for r in chat.formatted(chat.paths(df), df).collect()}
    assert chat.read_back(made[3].conversation, made[3].loss_mask) == ([("user", "q"), ("assistant", "\\>#")], "\\>#")
    assert chat.read_back(made[4].conversation, made[4].loss_mask) == ([("user", "q"), ("assistant", "x<"), ("user", "")], "x<")
    assert chat.paths(df.limit(0)).count() == 0


def test_cycles_with_tails_and_repeated_nodes_end(spark):
    # 8 <-> 9 with the tail 10 -> 8, 11 -> 10; 5 is its own parent; 1 -> 2 -> 3 given four times, 2 with another parent too
    nodes = [(1, 8, 9), (1, 9, 8), (1, 10, 8), (1, 11, 10), (1, 5, 5), (1, None, 1)] + 4 * [(1, 1, None), (1, 2, 1), (1, 3, 2)] + [(1, 2, 3)]
    df = spark.createDataFrame([(*n, 1.0, "user", f"t{n[1]}") for n in nodes], "tree_id long, node_id long, parent_id long, score double, role string, text string")
    got = chat.paths(df).collect()
    assert [(r.leaf_id, r.path) for r in got] == [(3, [1, 2, 3])]
    made = chat.formatted(chat.paths(df), df).collect()
    assert [chat.read_back(r.conversation, r.loss_mask)[0] for r in made] == [[("user", "t1"), ("user", "t2"), ("user", "t3")]]
    only_cycle = df.where("node_id in (8, 9)")
    assert chat.paths(only_cycle).count() == 0


def test_paths_are_brute_force(spark):
    rnd = random.Random(3)
    rows = [(t, i, rnd.randrange(i) if i and rnd.random() < 0.95 else None, rnd.random()) for t in range(6) for i in range(rnd.randrange(1, 60))]
    parent = {(t, i): p for t, i, p, _ in rows}
    score = {(t, i): s for t, i, _, s in rows}
    inner = {(t, p) for t, _, p, _ in rows}
    want = {}
    for t, i in parent:
        if (t, i) not in inner:
            path = [i]
            while parent[t, path[0]] is not None:
                path.insert(0, parent[t, path[0]])
            want[t, i] = (path, pytest.approx(sum(score[t, x] for x in path) / len(path)))
    got = chat.paths(spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, score double")).collect()
    assert {(r.tree_id, r.leaf_id): (r.path, r.score) for r in got} == want


def test_a_long_thread_takes_few_rounds(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("tree_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(1.0).alias("score"))
    assert chat.paths(df).first().path == list(range(n))


def test_conversations_round_trip(spark, sf):
    got = {r.conv_id: r for r in catalog.op4_chat_format(spark, sf).collect()}
    own = "\\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()
    rows = {}
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert {k: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in v).encode()).hexdigest() for k, v in rows.items()} == {k: r.turns_sha256 for k, r in got.items() if k != -7}


def test_warc_edge_cases_and_splits(spark, tmp_path):
    rnd = random.Random(1)
    noise = "".join(chr(rnd.randrange(32, 0x2FF)) for _ in range(300_000))
    big = "z" * (17 << 20)
    rows = [(5, "http://a", "same"), (3, "http://b\r\nX: 1", "same"), (3, None, "same"), (1, "u", None), (2, "u", ""), (None, "u", "same"), (9, "u", noise), (8, "u", "\x1f�\x08é"), (7, "u", big)]
    rows += [(100 + i, "u", noise[i : i + 2000]) for i in range(300)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int").coalesce(2)
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    for split in (1 << 30, 50_000):
        got = warc.read(spark, path, split).collect()
        assert len(got) == len(rows)
        assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got if (r.page_id or 0) < 10} == {(5, "revisit", 3, 4), (3, "response", None, 4), (1, "response", None, 0), (2, "revisit", 1, 0), (None, "revisit", 3, 4), (9, "response", None, len(noise.encode())), (8, "response", None, len("\x1f�\x08é".encode())), (7, "response", None, 17 << 20)}
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1\r\n") for p in files) == len(rows)
    # ranges of a few bytes, read directly: each record is owned once
    data = min((p.read_bytes() for p in files if p.stat().st_size), key=len)[:]
    whole = list(warc.members(io.BytesIO(data), 0, len(data)))
    cut = [m for a in range(0, len(data), 4999) for m in warc.members(io.BytesIO(data), a, min(len(data), a + 4999))]
    assert cut == whole
    empty = f"file://{tmp_path}/e"
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


class Counted(io.BytesIO):
    """A file that counts what is read of it."""

    n = 0

    def read(self, size=-1):
        got = super().read(size)
        self.n += len(got)
        return got


def test_warc_reads_each_byte_about_once():
    rnd = random.Random(4)
    records = [warc.record(i, "u", rnd.randbytes(rnd.randrange(1200)), "X", None) for i in range(6000)]
    data = b"".join(records)
    file, got = Counted(data), 0
    split = 1 << 20
    for a in range(0, len(data), split):
        got += sum(1 for _ in warc.members(file, a, min(len(data), a + split)))
    assert got == len(records) and file.n <= 2 * len(data)


def test_warc_magic_inside_payloads_and_damage():
    inner = gzip.compress(b"no record") + gzip.compress(b"WARX/1.1")
    data = b"".join(warc.record(i, "u", inner * 50 + bytes([i]), "X", None) for i in range(40))
    whole = list(warc.members(io.BytesIO(data), 0, len(data)))
    assert len(whole) == 40
    assert [m for a in range(0, len(data), 97) for m in warc.members(io.BytesIO(data), a, min(len(data), a + 97))] == whole
    with pytest.raises(ValueError, match="damaged"):
        list(warc.members(io.BytesIO(data[:-9]), 0, len(data) - 9))


def test_warc_least_size(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w", least=3)
    assert {(r.page_id, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/w").collect()} == {(1, None), (2, None), (3, None), (4, 3)}


def test_language_accuracy_and_edges(spark, sf):
    docs = table(spark, sf, "documents")
    got = language.identify(docs).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.truth for r in got]) > 0.9
    odd = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(None, "the and of", None), (-1, None, "en"), (-2, "", None), (-3, "12 !!", None), (-4, "a", "de"), (-5, "the " * 50000, None)], "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in language.identify(odd.withColumn("score", F.lit("clash"))).collect()}
    assert [out[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and out[-1].score == 0.0 and out[None].held_out is False
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_mixture_finds_two_languages():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(language.BUCKETS, 0.05), 3)
    counts = np.stack([rng.multinomial(600, 0.6 * p[0] + 0.4 * p[2]), rng.multinomial(600, p[1])]).astype(float)
    pi = language.mixture(counts, np.log(p + 1e-9))
    assert (pi[0] > 0).tolist() == [True, False, True] and abs(pi[0, 0] - 0.6) < 0.1
    assert (pi[1] > 0).tolist() == [False, True, False]


def test_mixture_is_brute_force():
    """The vectorised EM and thinning against one document at a time in plain Python, on the fit's own tables."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(language.BUCKETS, 0.02), 4)
    p = 0.99 * p + 0.01 / language.BUCKETS
    weights = rng.dirichlet(np.full(4, 0.4), 25)
    counts = np.stack([rng.multinomial(int(rng.integers(5, 900)), w @ p) for w in weights]).astype(float)
    got = language.mixture(counts, np.log(p))

    def em(w, c, rounds):
        for _ in range(rounds):
            w = [wi * sum(ci * qi / m for ci, qi, m in zip(c[hit], q[hit], (np.array(w) @ p)[hit])) / c.sum() for wi, q in zip(w, p)]
        return w

    for c, mine in zip(counts, got, strict=True):
        hit = c > 0
        bic = lambda w: -2 * float((c[hit] * np.log((np.array(w) @ p)[hit])).sum()) + sum(x > 0 for x in w) * np.log(c.sum())  # noqa: B023, E731
        w = [x if x >= 0.01 else 0.0 for x in em([0.25] * 4, c, language.ROUNDS)]
        w = [x / sum(w) for x in w]
        while sum(x > 0 for x in w) > 1:
            k = min((x, i) for i, x in enumerate(w) if x > 0)[1]
            less = [0.0 if i == k else x for i, x in enumerate(w)]
            less = [x / sum(less) for x in less]
            if sum(x > 0 for x in less) > 1:
                less = em(less, c, 4)
            if bic(less) > bic(w):
                break
            w = less
        assert np.allclose(w, mine, atol=1e-6)


def test_languages_that_are_learned_are_bounded(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    dirty = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    monkeypatch.setattr(language, "LANGUAGES", 3)
    langs, logp = language.fit(dirty)
    want = sorted(r.lang for r in dirty.where("lang is not null and text is not null").where(~language.held_out(F.col("doc_id"))).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(3).collect())
    assert langs == want and logp.shape == (3, language.BUCKETS)


def test_quality_sample_is_bounded_by_rows(spark, monkeypatch):
    """One doc_id a great many times is one row of the sample."""
    rows = [(7, "same", "s")] * 5000 + [(8, f"labelled {i}", "s") for i in range(3000)] + [(100 + i, f"good text {i}" if i % 2 else "!!! 111", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(8, 1, 0)] + [(100 + i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    seen = []
    train = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda c, m, y: seen.append(y) or train(c, m, y))
    quality.fit(docs, labels)
    assert len(seen[0]) == 302 and (seen[0] >= 0).sum() == 201
    quality.fit(docs, labels, labelled=50, pool=30)
    assert len(seen[1]) == 80
    again = quality.score(docs.repartition(7), labels).groupBy("doc_id").agg(F.min("quality_score").alias("q")).collect()
    assert sorted(again) == sorted(quality.score(docs, labels).groupBy("doc_id").agg(F.min("quality_score").alias("q")).collect())


def test_co_training_is_brute_force():
    """Two rounds of co-training against a plain version that keeps sets of pseudo-labels."""
    rng = np.random.default_rng(5)
    y = np.where(np.arange(400) < 120, rng.integers(0, 2, 400), -1)
    truth = np.where(y >= 0, y, rng.integers(0, 2, 400))
    views = [(rng.standard_normal((400, 5)) + truth[:, None] * [2, -1, 1, 0, 0]).astype(np.float32) for _ in range(2)]
    got = quality.co_train(*views, y, rounds=2, grow=0.1)
    known = [i for i in range(400) if y[i] >= 0]
    base, pool = [i for k, i in enumerate(known) if k % 5], [i for i in range(400) if y[i] < 0]
    share = min(0.95, max(0.05, float(np.mean(y[base]))))
    given = [{}, {}]

    def fitted(k):
        at = base + list(given[k])
        t = np.array([y[i] for i in base] + list(given[k].values()), np.float32)
        w = np.array([0.5 / t.mean() if x else 0.5 / (1 - t.mean()) for x in t])
        w[len(base) :] /= 2
        return quality.logistic(views[k][at], t, w)

    models = [fitted(0), fitted(1)]
    for _ in range(2):
        for k in (0, 1):
            left = sorted((float(views[k][i] @ models[k][:-1] + models[k][-1]), n, i) for n, i in enumerate(i for i in pool if i not in given[1 - k]))
            take = int(np.ceil(0.1 * len(pool)))
            for s, _, i in left[len(left) - round(take * share) :]:
                if s > 1:
                    given[1 - k][i] = 1.0
            for s, _, i in left[: take - round(take * share)]:
                if s < -1:
                    given[1 - k][i] = 0.0
        models = [fitted(0), fitted(1)]
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(models, got["models"], strict=True))
    margin = views[0] @ got["models"][0][:-1] + got["models"][0][-1]
    assert np.mean((margin > 0) == truth) > 0.8


def test_quality_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.score(docs, train).join(test, "doc_id").collect()
    assert np.mean([r.keep == bool(r.quality) for r in got]) > 0.9
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "", "s", "x"), (1, "", "s", "x"), (2, "w " * 50000, None, "x")], "doc_id long, text string, source string, keep string")
    assert quality.score(odd, train).count() == 4
    assert {r.quality_score for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score(odd.limit(0), train).count() == 0
