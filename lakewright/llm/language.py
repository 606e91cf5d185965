"""Language identification by multilingual mixture inference.

A document is a bag of hashed byte n-grams drawn from a mixture of languages. Expectation-maximisation
estimates the proportions; the set of languages is then thinned one by one while the penalised
likelihood (BIC) does not get worse. The n-gram tables are fitted on a documented, bounded sample of labelled
rows (``per_lang`` rows a language in expectation, chosen by a hash of the id).

Null text, empty text and text without letters get ``und`` and score 0; so does every document when there is
nothing to learn from. Languages of equal share tie to the first in code-point order. Repeated rows get equal results; text of
any length is used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lakewright.llm.common import only
from lakewright.storage import cut

#: Hash buckets of the n-gram tables.
BUCKETS = 4096
#: EM rounds and documents a batch; most languages that are learned: those with the most rows, ties in code-point order.
ROUNDS, BATCH, LANGUAGES = 12, 64, 200
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte 3-grams of lower-cased text, a space put on either side."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    h = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
    return np.bincount(h >> np.uint32(20), minlength=BUCKETS)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter."""
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 1500) -> tuple[list[str], np.ndarray]:
    """(languages in code-point order, log-probabilities languages x BUCKETS).

    Learns from rows with text, lang and id outside the held-out fold; about ``per_lang`` rows of each
    language by a hash of the id. The tables are summed in partial counts, of fixed size a language.
    """
    rows = only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r.lang: r.n for r in by.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    rates = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1e6, 1e6 * per_lang / sizes[k]))])
    sample = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000)) < rates[F.col("lang")])  # null: not learned

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                c = gram_counts(text)
                sums[lang] = sums.get(lang, 0) + c / c.sum()  # each document weighs the same
        yield pd.DataFrame([{"lang": k, "part": p, "counts": v[p * 256 : p * 256 + 256].tolist()} for k, v in sums.items() for p in range(BUCKETS // 256)], columns=["lang", "part", "counts"])

    parts = sample.select("lang", "text").mapInPandas(count, "lang string, part int, counts array<double>")
    total = parts.select("lang", "part", F.posexplode("counts")).groupBy("lang", "part", "pos").agg(F.sum("col").alias("n"))
    table = np.zeros((len(langs), BUCKETS))
    at = {k: i for i, k in enumerate(langs)}
    for r in total.where("n > 0").toPandas().itertuples():
        table[at[r.lang], r.part * 256 + r.pos] = r.n
    table = table / np.maximum(table.sum(1, keepdims=True), 1e-12)
    mean = table.mean(0)
    smooth = 0.97 * table + 0.02 * mean + 0.01 / BUCKETS
    return langs, np.log(smooth)


def mixture(counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Proportions (documents x languages) by EM, each document's set of languages thinned by BIC."""
    p = np.exp(logp)
    n = np.maximum(counts.sum(1, keepdims=True), 1.0)

    def em(pi: np.ndarray, c: np.ndarray, m: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            pi = pi * ((c / np.maximum(pi @ p, 1e-30)) @ p.T) / m
        return pi

    def loglik(pi: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (c * np.log(np.maximum(pi @ p, 1e-30))).sum(1)

    k = p.shape[0]
    pi = em(np.full((len(counts), k), 1.0 / k), counts, n, ROUNDS)
    pi = np.where(pi < 0.01, 0.0, pi)
    pi /= pi.sum(1, keepdims=True)
    bic = -2 * loglik(pi, counts) + (pi > 0).sum(1) * np.log(n[:, 0])
    todo = np.flatnonzero((pi > 0).sum(1) > 1)
    while len(todo):
        less = pi[todo].copy()
        least = np.where(less > 0, less, np.inf).argmin(1)
        less[np.arange(len(todo)), least] = 0.0
        less /= less.sum(1, keepdims=True)
        if ((less > 0).sum(1) > 1).any():
            less = em(less, counts[todo], n[todo], 4)
        score = -2 * loglik(less, counts[todo]) + (less > 0).sum(1) * np.log(n[todo, 0])
        better = score <= bic[todo]
        pi[todo[better]], bic[todo[better]] = less[better], score[better]
        todo = todo[better & ((less > 0).sum(1) > 1)]
    return pi


def identify(docs: DataFrame, per_lang: int = 1500) -> DataFrame:
    """``docs`` with held_out boolean, lang_pred string, score double and languages (the kept mixture).

    Only the text enters a prediction. Columns of ``docs`` with those names are replaced.
    """
    langs, logp = fit(docs, per_lang)
    clash = [c for c in ("held_out", "lang_pred", "score", "languages") if c in docs.columns]
    docs = docs.drop(*clash)

    @F.pandas_udf("struct<lang_pred string, score double, languages map<string,double>>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, kept = [UNKNOWN] * len(texts), [0.0] * len(texts), [{}] * len(texts)
            rows = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            for s in range(0, len(rows), BATCH):
                part = rows[s : s + BATCH]
                pi = mixture(np.stack([gram_counts(texts.iat[i]) for i in part]).astype(float), logp)
                for i, w in zip(part, pi, strict=True):
                    names[i], scores[i] = langs[int(w.argmax())], float(min(1.0, w.max()))
                    kept[i] = {langs[j]: float(w[j]) for j in np.flatnonzero(w)}
            yield pd.DataFrame({"lang_pred": names, "score": scores, "languages": kept})

    scored = docs.withColumn("_lid", predict(docs["text"]))
    return scored.select(*(scored[c] for c in docs.columns), held_out(scored["doc_id"]).alias("held_out"), "_lid.lang_pred", "_lid.score", "_lid.languages")
