"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Index: spherical k-means on a bounded sample (``SAMPLE`` rows with the least hash of the id) gives inverted lists; every
row is put on the list of its nearest centre, but for a first list of ``FIRST`` sampled rows, which all queries visit and which
gives each a bound on its k-th best score. A query visits the lists nearest to it until they hold a share of all rows; the share
is the least at which sampled queries find ``TARGET`` of their nearest neighbours in the sample. Lists are visited in rounds, nearest
first, each ending at ``GROWTH`` times as many rows as the one before: the bound found by then keeps what a round returns for a
query to a few times k at any size.

Vectors are rotated at random, so that the first dimensions of any are a fair sample of all. On a list, candidates are
scanned in blocks of columns: after each block a hypothesis test on the partial distance (scaled to all dimensions, with
a margin that shrinks as 1 / sqrt(columns seen)) abandons those that are surely farther than the bound allows. The
inner product of vectors of any norm becomes a distance by |q|^2 + |x|^2 - 2 q.x. Survivors are scored on the original
vectors in double precision.

Lists longer than ``CHUNK`` are dealt to chunks by a hash of the id, so copies of one vector don't meet in one task. A task holds
one chunk at a time and lets the queries that visit it stream by, so neither side is copied for the other's size or held whole.
Null and zero vectors, and vectors that hold null or non-finite components, take no part; nor do vectors whose length is not the
commonest. Of rows that share an id the one with the least vector counts. Fewer than k candidates: all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lakewright.llm.common import only
from lakewright.storage import cut, shuffle_width

#: Rows of the fit's sample, most lists, rows a chunk of a list, columns a block, the test's margin.
SAMPLE, LISTS, CHUNK, COLUMNS, MARGIN = 20_000, 1024, 4096, 16, 2.1
#: Rows of the first list, how much more each round visits, queries scanned together.
FIRST, GROWTH, TOGETHER = 512, 8, 256
#: Recall on the sample that sets the share of rows to visit, and how many queries measure it.
TARGET, MEASURED = 0.97, 400


def usable(table: DataFrame, key: str, vec: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = only(table, key, vec).select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).agg(F.max(F.struct("c", F.negative("n").alias("n")))["n"].alias("n")).first()
    return rows.where(F.size("v") == F.lit(-(size.n if size and size.n is not None else 0)))


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same each time."""
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of ``k`` or fewer clusters of the sample's directions."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-12, sums / np.maximum(n, 1e-12), c)
    return c


def best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, slack: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(row of q, id, exact score) of the k best of each row of ``scores`` (approximate; -inf: none), near ties within ``slack`` settled exactly."""
    if scores.shape[1] > k:  # a matrix product rounds equal vectors differently, so near ties of the k-th stay
        scores = np.where(scores >= (np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] - slack)[:, None], scores, -np.inf)
    i, j = np.nonzero(scores > -np.inf)
    exact = np.concatenate([np.cumsum(q[i[lo : lo + 8192]] * x[j[lo : lo + 8192]], axis=1)[:, -1] for lo in range(0, len(i), 8192)] or [np.zeros(0)])  # summed in order of columns: equal vectors tie
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return list(zip(i[keep].tolist(), ids[j[keep]].tolist(), exact[keep].tolist(), strict=True))


def scan(q: np.ndarray, qr: np.ndarray, bound: np.ndarray, own: np.ndarray, x: np.ndarray, xr: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(row of q, id, score) of the k best rows of a chunk for each query, scanned in column blocks with early abandoning.

    ``bound``: a score that the query's k-th best reaches at least. A block of columns is read for the rows that some query still holds.
    """
    dims, alive, rows = qr.shape[1], own[:, None] != ids, np.arange(len(ids))
    norms, sizes = np.einsum("ij,ij->i", xr, xr), np.einsum("ij,ij->i", qr, qr)
    slack = 1e-9 * (np.sqrt(sizes * norms.max()) + 1e-300)
    limit = np.maximum(norms + (sizes - 2 * (bound - slack))[:, None], 0)
    dots, seen_q, seen_x = np.zeros_like(limit), np.zeros(len(q)), np.zeros(len(ids))
    for lo in range(0, dims, COLUMNS):
        seen = min(lo + COLUMNS, dims)
        dots += qr[:, lo:seen] @ xr[rows, lo:seen].T
        if seen == dims:
            break
        seen_q += np.einsum("ij,ij->i", qr[:, lo:seen], qr[:, lo:seen])
        seen_x += np.einsum("ij,ij->i", xr[rows, lo:seen], xr[rows, lo:seen])
        alive &= (seen_q[:, None] + seen_x - 2 * dots) * (dims / seen / (1 + MARGIN / np.sqrt(seen)) ** 2) <= limit
        some = alive.any(0)
        if some.sum() < 0.8 * len(rows):  # rows that all queries abandoned go
            rows, seen_x = rows[some], seen_x[some]
            alive, dots, limit = alive[:, some], dots[:, some], limit[:, some]
    return best(np.where(alive & (dots >= (bound - slack)[:, None]), dots, -np.inf), q, x[rows], ids[rows], slack, k)


def packed(vectors: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in np.ascontiguousarray(vectors)]


def unpacked(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dims)


def sampled_share(sample: np.ndarray, mid: np.ndarray, k: int, target: float) -> float:
    """Least share of all rows that queries must visit to find ``target`` of their k nearest: measured on the sample."""
    own = np.concatenate([(sample[i : i + 4096] @ mid.T).argmax(1) for i in range(0, len(sample), 4096)])
    sizes = np.bincount(own, minlength=len(mid))
    asked = np.arange(0, len(sample), max(1, len(sample) // MEASURED))
    before = []  # for each true neighbour, how many rows the lists before its own hold
    for i in asked:
        scores = sample @ sample[i]
        scores[i] = -np.inf
        near = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
        order = np.argsort(-(mid @ sample[i]), kind="stable")
        held = np.empty(len(mid))
        held[order] = np.cumsum(sizes[order]) - sizes[order]
        before.append(held[own[near]])
    return float(np.quantile(np.concatenate(before), target)) / len(sample)


def search(
    table: DataFrame, is_query, k: int = 20, share: float | None = None, key: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` of the id holds, its k nearest other rows.

    ``share``: of all rows, how many the visited lists hold at least; None: as the sample says.
    """
    spark = table.sparkSession
    rows = cut(usable(table, key, vec), "vectors")
    total = rows.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out)
    sample = [(r.vec_id, r.v) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    first_ids, first = np.array([i for i, _ in sample[:FIRST]], np.int64), np.array([v for _, v in sample[:FIRST]])
    sample = np.array([v for _, v in sample])
    dims, turn = sample.shape[1], rotation(sample.shape[1])
    mid = centres(sample, int(np.clip(np.sqrt(total), 1, min(LISTS, len(sample)))))
    share = sampled_share(sample, mid, k, TARGET) if share is None else share
    top = np.sqrt((first * first).sum(1).max())

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[~pdf["vec_id"].isin(first_ids)]
            x = np.array(pdf["v"].tolist(), np.float64).reshape(-1, dims)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), "list": (x @ mid.T).argmax(1).astype(np.int32), "v": packed(x)})

    listed = cut(rows.mapInPandas(assign, "vec_id long, list int, v binary"), "lists")
    counts = {r.list: r.n for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    sizes = np.array([counts.get(i, 0) for i in range(len(mid))])
    enough = min(int(sizes.sum()), max(4 * k + 1, int(share * total) + 1))
    ends = [FIRST * GROWTH]  # rows visited by the end of each round
    while ends[-1] < enough:
        ends.append(ends[-1] * GROWTH)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), TOGETHER):
                pdf = whole.iloc[at : at + TOGETHER]
                q, own = np.array(pdf["v"].tolist(), np.float64).reshape(-1, dims), pdf["vec_id"].to_numpy()
                scores = np.where(own[:, None] != first_ids, q @ first.T, -np.inf)
                found = best(scores, q, first, first_ids, 1e-9 * top * np.sqrt((q * q).sum(1)), k)
                hits = [[] for _ in own]
                for i, j, s in found:
                    hits[i].append({"vec_id": j, "score": s})
                near = np.argsort(-(q @ mid.T), axis=1, kind="stable")
                lists = []
                for r in near:
                    held = np.cumsum(sizes[r]) - sizes[r]  # rows before each list; they say in which round it is due
                    due = np.searchsorted(ends, held, "right")
                    lists.append([{"list": int(j), "turn": int(t)} for j, t, h in zip(r, due, held, strict=True) if sizes[j] and h < enough])
                yield pd.DataFrame({"query_id": own, "lists": lists, "q": packed(q), "hits": hits})

    made = "query_id long, lists array<struct<list: int, turn: int>>, q binary, hits array<struct<vec_id: long, score: double>>"
    asked = cut(rows.where(is_query(F.col("vec_id"))).mapInPandas(visit, made), "asked")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    found = asked.select("query_id", F.inline("hits")).withColumn("rank", ranked)
    if not sizes.sum():
        return found.select("query_id", "rank", "vec_id", "score")
    chunks = F.create_map(*[F.lit(int(z)) for i, s in enumerate(sizes) if s for z in (i, -(-s // CHUNK))])
    chunk = F.pmod(F.xxhash64("vec_id"), chunks[F.col("list")]).cast("int").alias("chunk")
    held = listed.select("list", chunk, F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v", F.lit(0.0).alias("bound"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by (list, chunk), in each the chunk's vectors and then its queries."""
        here, parts, x, xr, ids = None, [], None, None, None
        for pdf in batches:
            at = pdf["list"].to_numpy(np.int64) << 32 | pdf["chunk"].to_numpy(np.int64)
            asks, found = pdf["asks"].to_numpy(bool), []
            runs = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(asks) != 0), [True])))
            for lo, hi in zip(runs[:-1], runs[1:], strict=True):
                if at[lo] != here:
                    here, parts, x = at[lo], [], None
                run = pdf.iloc[lo:hi]
                if not asks[lo]:
                    parts.append((unpacked(run["v"], dims), run["id"].to_numpy()))
                    continue
                if x is None and parts:
                    x, ids = np.concatenate([p for p, _ in parts]), np.concatenate([i for _, i in parts])
                    xr = x @ turn
                for k0 in range(0, len(run) if x is not None else 0, TOGETHER):
                    part = run.iloc[k0 : k0 + TOGETHER]
                    q, own = unpacked(part["v"], dims), part["id"].to_numpy()
                    found += [(own[i], j, s) for i, j, s in scan(q, q @ turn, part["bound"].to_numpy(), own, x, xr, ids, k)]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    tasks = max(shuffle_width(spark), min(10_000, int((-(-sizes // CHUNK)).sum()) // 4))
    for r in range(len(ends)):
        bound = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        due = asked.select("query_id", "q", F.filter("lists", lambda x: x["turn"] == r).alias("lists")).where(F.size("lists") > 0)
        due = due.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        sent = due.select("query_id", "q", "bound", F.explode("lists.list").alias("list"))
        every = F.explode(F.sequence(F.lit(0), chunks[F.col("list")] - 1)).alias("chunk")
        sent = sent.select("list", every, F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("q").alias("v"), "bound")
        dealt = held.union(sent).repartition(tasks, "list", "chunk").sortWithinPartitions("list", "chunk", "asks")
        new = dealt.mapInPandas(stream, "query_id long, vec_id long, score double")
        found = found.drop("rank").union(new).withColumn("rank", ranked).where(F.col("rank") <= k)
        if r + 1 < len(ends):
            found = cut(found, "nearest")
    return found.select("query_id", "rank", "vec_id", "score")
