"""Quality classification by co-training.

Two views of a document: its content (hashed byte n-grams) and its page metadata (source, lengths, layout and
character-class shares). A logistic classifier of each view starts from the labels; for some rounds each labels the
unlabelled rows that it is surest of, as many of either class as the labels' shares say, for the other view. Each
view is then calibrated (Platt) on labelled rows that neither fit has seen, and the mean log-odds scores all documents.

The fit uses a bounded sample: ``labelled`` labelled and ``pool`` unlabelled rows, those with the least hash of
the id. Scoring covers every row. Null text counts as empty; without labels of both classes every document
scores 0.5 and is kept. Rows of ``labels`` with null fields are ignored; of repeated labels the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lakewright.llm.common import only
from lakewright.storage import cut

#: Hashed content features; metadata features: SOURCES hashed sources and the shape features.
CONTENT, SOURCES, SHAPES = 512, 32, 14
META = SOURCES + SHAPES
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\f\v", b"\n", bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))), 1):
    _CLASS[list(_chars)] = _k


def content_view(text: str) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed byte 3-grams, letters' case kept."""
    b = np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(CONTENT, np.float32)
    h = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
    v = np.sqrt(np.bincount(h >> np.uint32(23), minlength=CONTENT).astype(np.float32))
    return v / np.linalg.norm(v)


def metadata_view(text: str, source: str | None) -> np.ndarray:
    """Hashed source, log lengths, shares of character classes, repetition of lines and words."""
    v = np.zeros(META, np.float32)
    raw = text.encode("utf-8", "replace")
    key = 0
    for x in (source or "").encode("utf-8", "replace"):
        key = (key * 131 + x) & 0xFFFFFFFF
    v[key % SOURCES] = 1
    n = max(1, len(raw))
    shares = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7)[:7] / n
    lines, words = text.split("\n"), text.split()
    w = max(1, len(words))
    v[SOURCES:] = [np.log1p(n) / 10, np.log1p(len(lines)) / 5, np.log1p(n / len(lines)) / 8, *shares * 3, len(set(lines)) / len(lines), len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w * 3, len(words) / n * 6]
    return v


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (last: intercept) of an L2-penalised, row-weighted logistic fit by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = (w / w.sum()).astype(x.dtype)
    step = 4.0 / max(float((w[:, None] * x * x).sum(0).sum()), 1e-6)
    b = z = np.zeros(x.shape[1], x.dtype)
    for t in range(rounds):
        g = x.T @ (w * (_sigmoid(x @ z) - y)) + l2 * z
        new = z - step * g
        z, b = new + t / (t + 3) * (new - b), new
    return b


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _margin(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ b[:-1] + b[-1]


def platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the log-odds as a function of the margin, by Newton steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * s + c)
        g = np.array([((p - t) * s).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * s * s).sum() + 1e-3, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, c = a - d[0], c - d[1]
        if abs(d).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(c)


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = 3, grow: float = 0.2) -> dict | None:
    """The two views' weights and calibrations; y is 1, 0, or -1 where unlabelled. None without both classes."""
    rows = np.arange(len(y))
    known = rows[y >= 0]
    if len(known) == 0 or y[known].min() == y[known].max():
        return None
    fold = known[np.arange(len(known)) % 5 == 0]  # kept for calibration
    if y[fold].min() == y[fold].max():
        fold = known
    base = np.setdiff1d(known, fold) if len(fold) < len(known) else known
    if y[base].min() == y[base].max():
        base = known
    share = float(np.clip(y[base].mean(), 0.05, 0.95))
    views, pool = [content, meta], rows[y < 0]
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view has been given by the other

    def fitted(k: int) -> np.ndarray:
        at = np.concatenate([base, np.fromiter(given[k], np.int64, len(given[k]))])
        target = np.concatenate([y[base], np.fromiter(given[k].values(), float, len(given[k]))]).astype(np.float32)
        weight = np.where(target > 0, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6))
        weight[len(base) :] *= 0.5
        return logistic(views[k][at], target, weight)

    models = [fitted(0), fitted(1)]
    for _ in range(rounds):
        for k in (0, 1):
            left = np.setdiff1d(pool, np.fromiter(given[1 - k], np.int64, len(given[1 - k])))
            if not len(left):
                continue
            s = _margin(views[k][left], models[k])
            order, take = np.argsort(s, kind="stable"), int(np.ceil(grow * len(pool)))
            n_pos = round(take * share)
            for i in order[len(order) - n_pos :]:
                if s[i] > 1:
                    given[1 - k][int(left[i])] = 1.0
            for i in order[: take - n_pos]:
                if s[i] < -1:
                    given[1 - k][int(left[i])] = 0.0
        models = [fitted(0), fitted(1)]
    return {"models": models, "scales": [platt(_margin(views[k][fold], models[k]), y[fold]) for k in (0, 1)]}


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 6000, pool: int = 6000) -> dict | None:
    """Co-trained views from a bounded sample: at most ``labelled`` + ``pool`` rows reach the driver.

    The sample takes documents by the least hash of their id; of rows that share an id, the one with the least text and source.
    """
    marks = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = only(docs, "doc_id", "text", "source").where("doc_id is not null")
    ids = rows.select("doc_id").distinct()
    order = [F.xxhash64(F.col("doc_id"), F.lit(11)), F.col("doc_id")]
    some = marks.join(ids, "doc_id", "left_semi").orderBy(*order).limit(labelled)
    none = ids.join(marks, "doc_id", "left_anti").orderBy(*order).limit(pool)
    chosen = some.select("doc_id", F.col("quality").cast("int").alias("y")).union(none.select("doc_id", F.lit(-1)))
    chosen = cut(chosen, "chosen")  # labelled + pool rows at most
    if not chosen.where("y >= 0").take(1):
        return None
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "source")).alias("r"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            yield pd.DataFrame({"h": [hash_text(t) for t in texts], "y": pdf["y"], "c": [content_view(t).tobytes() for t in texts], "m": [metadata_view(t, s).tobytes() for t, s in zip(texts, pdf["source"], strict=True)]})

    pdf = one.select("r.text", "r.source", "y").mapInPandas(features, "h long, y int, c binary, m binary").toPandas().sort_values(["y", "h", "c"]).reset_index(drop=True)
    stack = lambda col, n: np.frombuffer(b"".join(pdf[col]), np.float32).reshape(-1, n)
    return co_train(stack("c", CONTENT), stack("m", META), pdf["y"].to_numpy())


def hash_text(text: str) -> int:
    """A stable order for the sample's rows."""
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


def score(docs: DataFrame, labels: DataFrame, labelled: int = 6000, pool: int = 6000, threshold: float = 0.5) -> DataFrame:
    """``docs`` with quality_score double (0 to 1), content_score, metadata_score double and keep boolean.

    Columns of ``docs`` with those names are replaced.
    """
    model = fit(docs, labels, labelled, pool)
    docs = docs.drop(*(c for c in ("quality_score", "content_score", "metadata_score", "keep") if c in docs.columns))

    @F.pandas_udf("struct<q double, c double, m double>")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, sources in batches:
            if model is None:
                half = np.full(len(texts), 0.5)
                yield pd.DataFrame({"q": half, "c": half, "m": half})
                continue
            odds = []
            for k in (0, 1):
                made = (content_view(t or "") for t in texts) if k == 0 else (metadata_view(t or "", s) for t, s in zip(texts, sources, strict=True))
                x = np.array(list(made), np.float32).reshape(len(texts), (CONTENT, META)[k])
                a, c = model["scales"][k]
                odds.append(np.clip(a * _margin(x, model["models"][k]) + c, -12, 12).astype(float))
            yield pd.DataFrame({"q": _sigmoid((odds[0] + odds[1]) / 2), "c": _sigmoid(odds[0]), "m": _sigmoid(odds[1])})

    out = docs.withColumn("_q", apply(docs["text"], docs["source"]))
    return out.select(*(out[c] for c in docs.columns), F.col("_q.q").alias("quality_score"), F.col("_q.c").alias("content_score"), F.col("_q.m").alias("metadata_score"), (F.col("_q.q") >= threshold).alias("keep"))
