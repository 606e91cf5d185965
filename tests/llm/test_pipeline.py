"""Each stage of the pipeline against a brute-force version, on its own input."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lakewright.llm import language, mixing, packing, quality
from lakewright.storage import table

SF = "/root/testdata/sf0.001"


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def language_kept(spark, docs):
    """Documents with a share of LANGUAGE_SHARE for one language, by plain EM over each document's own n-grams."""
    langs, logp = language.fit(docs)
    p = np.exp(logp)
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            continue
        c = language.gram_counts(r.text).astype(float)

        def em(names):
            w = np.full(len(names), 1 / len(names))
            for _ in range(12):
                mix = w @ p[names]
                w = w * (p[names] @ (c / mix)) / c.sum()
            bic = -2 * (c * np.log(w @ p[names])).sum() + len(names) * np.log(c.sum())
            return bic, w

        best = min((em([k]) for k in range(len(langs))), key=lambda x: x[0])[1]
        every = em(list(range(len(langs))))[1]
        if max(best.max() if every.max() > 0.9 else 0, every.max()) >= corpus_pipeline.LANGUAGE_SHARE:
            yield r


def quality_kept(spark, docs):
    """Documents whose mean log-odds of the two views, each computed by itself, reach QUALITY."""
    model = quality.fit(docs, table(spark, SF, "labels"))
    for r in docs.collect():
        odds = []
        for view, b, (a, c) in zip((quality.content_view(r.text or ""), quality.metadata_view(r.text or "", r.source)), model["models"], model["scales"], strict=True):
            odds.append(min(12, max(-12, a * (sum(float(x) * float(w) for x, w in zip(view, b, strict=False)) + float(b[-1])) + c)))
        if 1 / (1 + np.exp(-sum(odds) / 2)) >= corpus_pipeline.QUALITY:
            yield r


def duplicates_kept(spark, docs):
    """One document of each component of links, by all pairs."""
    rows, kept = docs.collect(), {}
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
        break
    for r, k in zip(rows, root, strict=True):
        kept[k] = min(kept.get(k, r), r, key=lambda r: r.doc_id)
    yield from kept.values()


def test_pipeline_stages_are_brute_force(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    for (_, stage), brute in zip(corpus_pipeline.STAGES, (language_kept, quality_kept, duplicates_kept), strict=False):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in brute(spark, docs))
        docs = spark.createDataFrame(out.collect(), docs.schema)
    # mixing: each source's words come near its target, no document more than three times
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    copies, by = Counter(r.doc_id for r in mixed), Counter()
    for r in mixed:
        by[r.source] += n_words(r.text)
    goal = {r.source_key: (r.target, r.size) for r in sorted(mixing.mix(docs).collect(), key=lambda r: r.size)}
    assert max(copies.values()) <= 3 and {r.doc_id for r in mixed} <= {r.doc_id for r in docs.collect()}
    assert all(abs(by[s] - goal["1" if s is None else "0" + s][0]) <= goal["1" if s is None else "0" + s][1] for s in by)
    # packing: all words, in bins of permitted lengths
    docs = spark.createDataFrame(mixed, docs.schema)
    got = corpus_pipeline.pack(spark, docs, SF).collect()
    assert sum(r.n_words for r in got) == sum(n_words(r.text) for r in mixed)
    bins = Counter()
    for r in got:
        bins[r.bin_id, r.bin_length] += r.n_words
    assert all(n <= length and length in packing.LENGTHS for (_, length), n in bins.items())


def test_pipeline_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "n_words", "bin_id", "bin_length", "bin_offset"] and out.count() > 0


ODD = [(None, None, None, None, 0, 1), (None, "the and", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (1, "the and", None, None, 0, 1), (1, "the and", None, None, 0, 1), (1, "une autre", "fr", "t", 0, 1), (2, "w " * 30000, None, "t", 0, 1)]


def test_pipeline_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, score int")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found[name] = out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert out.columns == docs.columns or name == "best-fit packing"
    assert all(any(c.isalpha() for c in r.text) for r in found["language ID"])
    assert Counter((r.doc_id, r.text) for r in found["quality classifier"]) <= Counter(r[:2] for r in ODD)
    # of the rows of doc_id 1 one stays, always the same; rows without an id stay
    near = found["n-gram Jaccard join"]
    assert Counter(r.doc_id for r in near) == {None: 2, 1: 1, 2: 1}
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(5), SF).collect()
    assert sorted(map(str, near)) == sorted(map(str, again))
    assert sum(r.n_words for r in found["best-fit packing"]) == sum(n_words(r[1]) for r in ODD)


def test_stages_write_and_release(spark, tmp_path):
    """Scratch tables of the stages but the last rows are gone after a run."""
    from lakewright import storage

    before = {k: len(v) for k, v in storage._written.items()}
    corpus_pipeline.run(spark, SF)
    extra = {k: v for k, v in storage._written.items() if k not in before and v}
    assert sum(map(len, extra.values())) == 1


@pytest.mark.parametrize("name", ["language", "quality"])
def test_without_anything_to_learn(spark, name):
    docs = spark.createDataFrame([(1, "a b", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    if name == "language":
        assert corpus_pipeline.language_id(spark, docs, SF).count() == 0
    else:
        none = table(spark, SF, "labels").limit(0)
        assert quality.score(docs, none).first().keep
