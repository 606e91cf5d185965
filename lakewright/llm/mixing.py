"""Mixing sources to target weights by the cube method.

A source's target asks for target / size copies of each of its documents: the whole part is taken for sure, the fraction
is an inclusion probability. The cube method's flight phase moves these probabilities along the null space of the
constraints (words and documents taken, for each source) until they are 0 or 1. Documents of a source fly in
buckets of about ``BUCKET`` rows, chosen by a hash of their ids, so a hot source is many buckets; the two rows or fewer
that a bucket leaves undecided fly again in buckets of the next level, until a single bucket of each source is
left, whose last rows land on the 0/1 choice nearest the target. All draws are hashes: reruns agree, however the
input is partitioned.

Null text has size 0; null source is a source of its own, last in order. Documents of size 0 are drawn too, though they
take no words. Repeated rows are drawn one by one. Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lakewright.llm.common import only, word_count
from lakewright.operators.ordering import running
from lakewright.storage import cut

#: Rows a bucket, about; the weights by rank of source; most copies of a source's words.
BUCKET, WEIGHTS, MOST = 1024, (5.0, 2.0, 1.0), 3.0
#: Sources up to which their facts are broadcast.
FEW = 50_000
#: Below this a probability counts as 0, above 1 minus it as 1.
EPS = 1e-9


def source_key(df: DataFrame):
    """The source with a mark in front, so that null is a value and sorts last."""
    return F.coalesce(F.concat(F.lit("0"), df["source"]), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source_key, source_size, target) from (source_key, size) rows: one row a source.

    Targets share the sum of all sizes by weight; a target stops at ``most`` times its source's size, and the excess
    goes to the others by weight. Sources in order of the share at which they stop: those before the first that
    the remaining share does not fill are full, the others get weight x share.
    """
    by = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    by = running(by, [F.col("source_key")], number="place")
    rank = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank + 1))
    by = by.withColumn("top", F.lit(most) * F.col("source_size")).withColumn("stops", F.col("top") / F.col("weight"))
    by = running(by, [F.col("stops"), F.col("source_key")], {"full": "top", "light": "weight"})
    whole = by.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("heavy"))
    by = by.crossJoin(F.broadcast(whole))  # one row
    by = by.withColumn("share", (F.col("all") - F.col("full")) / (F.col("heavy") - F.col("light")))
    level = by.agg(F.min(F.when(F.col("share") <= F.col("stops"), F.struct("row", "share")))["share"].alias("level"))
    target = F.least(F.col("top"), F.col("weight") * F.coalesce("level", "share"))
    return by.crossJoin(F.broadcast(level)).select("source_key", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Probabilities after the flight: all but two or fewer are 0 or 1; sums of p and of p * size stay.

    Three undecided rows always leave a direction that keeps both sums; the step to either end of the segment inside the cube is
    drawn so that each probability is kept on average.
    """
    p, at = p.copy(), []
    scale = size / max(float(size.max(initial=0)), 1.0)
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            at.append(i)
        if len(at) < 3:
            continue
        a, b, c = at
        u = [scale[b] - scale[c], scale[c] - scale[a], scale[a] - scale[b]]
        if max(map(abs, u)) < 1e-15:
            u = [1.0, -1.0, 0.0]
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(at, u, strict=True) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(at, u, strict=True) if v)
        step = up if draw[i] * (up + down) < down else -down
        for k, v in zip(at, u, strict=True):
            p[k] += step * v
        at = [k for k in at if EPS < p[k] < 1 - EPS]
    return np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p))


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 0/1 choice for a few undecided rows whose words come nearest the expected; ties to fewer rows."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    want = float((p[open_] * size[open_]).sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[k] for j, k in enumerate(open_) if m >> j & 1) - want), bin(m).count("1"), m))
    out = p.copy()
    for j, k in enumerate(open_):
        out[k] = best >> j & 1
    return out


def _draws(ids: pd.Series, level: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{level}:{i}:{k}".encode(), digest_size=8).digest(), "big") / 2.0**64 for k, i in enumerate(ids)])


_FLOWN = "doc_id string, source_key string, size long, nth long, source_size long, target double, whole int, p double, again long"


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, source_key, size, source_size, target, copies, taken) of every row of ``docs``."""
    # ids travel as text: pandas would make floats of ids beside nulls
    rows = only(docs, "doc_id", "text", "source")
    rows = rows.select(F.col("doc_id").cast("string"), source_key(rows).alias("source_key"), word_count(F.col("text")).alias("size"))
    # rows that share id, source and size are counted and numbered, so that they too are spread over buckets
    same = rows.groupBy("doc_id", "source_key", "size").agg(F.count("*").alias("k"))
    rows = cut(same.select("doc_id", "source_key", "size", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("nth")), "sizes")
    goal = targets(rows, weights, most)
    # a source is joined by its target and number of buckets; both are one row a source
    count = rows.groupBy("source_key").agg(F.count("*").alias("n"))
    rows = _by_source(rows, goal.join(count, "source_key"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(EPS)).cast("int")
    rows = rows.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), ratio - whole))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "nth"), F.ceil(F.col("n") / BUCKET)))
    largest = rows.groupBy().agg(F.max("n")).first()[0] or 0
    done, level = [], 0
    while largest:
        last = largest <= BUCKET
        flown = cut(_fly(rows, level, last), "mix")
        done.append(flown.where("again is null"))
        if last:
            break
        # of each bucket two rows or fewer are left, in as many buckets as the next level needs
        left = flown.where("again is not null")
        n = left.groupBy("source_key").agg(F.count("*").alias("n"))
        largest, level = n.agg(F.max("n")).first()[0] or 0, level + 1
        rows = _by_source(left, n).withColumn("bucket", F.pmod(F.col("again"), F.ceil(F.col("n") / BUCKET)))
    spark = docs.sparkSession
    out = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], _FLOWN)
    copies = F.col("whole") + F.col("p").cast("int")
    return out.select(F.col("doc_id").cast("long"), "source_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _by_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with their source's facts; these are broadcast if the sources, counted first, are few, else joined by key."""
    per = cut(per, "sources")
    return rows.join(F.broadcast(per) if per.count() <= FEW else per, "source_key")


def _fly(rows: DataFrame, level: int, last: bool) -> DataFrame:
    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "nth"], na_position="last").reset_index(drop=True)
        size = pdf["size"].to_numpy(float)
        p = flight(pdf["p"].to_numpy(float), size, _draws(pdf["doc_id"], level))
        if last:
            p = landing(p, size)
        undecided = (p > 0) & (p < 1)
        again = pd.array(np.where(undecided, int(pdf["bucket"].iloc[0]), 0), "Int64")
        again[~undecided] = pd.NA
        return pdf.assign(p=p, again=again)[[c.split()[0] for c in _FLOWN.split(", ")]]

    keep = [c.split()[0] for c in _FLOWN.split(", ") if not c.startswith("again")]
    return rows.select(*keep, "bucket").groupBy("source_key", "bucket").applyInPandas(bucket, _FLOWN)


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it: its columns, rows of no copies left out.

    Rows of one doc_id, source and size get the same number of copies each, their total spread from the first by text hash on.
    Texts go through one shuffle at most: the window is dealt as the join is.
    """
    key = ["_i", "_z", "_s", "_n"]
    named = lambda i: [F.coalesce(i, F.lit(0)).alias("_i"), i.isNull().alias("_z")]
    made = mix(docs)
    take = made.select(*named(F.col("doc_id")), F.col("source_key").alias("_s"), F.col("size").alias("_n"), "copies")
    take = take.groupBy(*key).agg(F.sum("copies").alias("_c"), F.count("*").alias("_k")).where("_c > 0")
    id_ = docs["doc_id"].cast("long")
    rows = docs.select("*", *named(id_), source_key(docs).alias("_s"), word_count(docs["text"]).alias("_n"))
    joined = rows.join(take, key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(docs["text"])))
    copies = F.floor(F.col("_c") / F.col("_k")) + (nth <= F.col("_c") % F.col("_k")).cast("long")
    spread = joined.withColumn("_copies", copies).where("_copies > 0")
    spread = spread.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return spread.select(*(docs[c] for c in docs.columns))
