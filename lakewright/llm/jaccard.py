"""Exact n-gram Jaccard join.

A document's set holds its distinct n-word shingles (lower-cased A-Z only). Sets are compared as 64-bit hashes.

1. Equal sets form one class; only a class's least doc_id goes on (aggregated with map-side combine). Texts are hashed here
   once; only those of candidates are hashed again.
2. Candidates are lossless for any threshold. In the order of the hashes, linked sets share at least ``floor_of`` shingles of
   their prefixes, which hold the shingles that may differ and ``MORE[0]`` times as many more. On a shingle's list, sorted by set size, only
   neighbours whose sizes allow a link count. A set with too few prefix shingles that it shares with such neighbours has no
   partner and goes, which is what most documents with a common passage do; this is done twice. Shingles that a bounded sample
   shows on many sets are dealt by set, not by shingle, so that no list of a frequent passage meets in one task.
3. Candidate groups (connected components along the lists) become blocks of bounded size. Each block is searched by
   T-occurrence: DivideSkip sets the longest inverted lists aside, merges the short ones with a heap for documents that
   reach T - L, and probes the long lists by binary search. In groups of several blocks a few documents of each component
   then meet a few of the largest one, which joins the parts of a large family. What is still outside the largest component meets
   the documents of its lists that sketches allow; on lists of frequent shingles it's the sketches of all that are compared, block
   by block, and sets are sent to the nearest, then to what is still apart, so no link across blocks is lost.
4. Links' connected components give each document its ``component_id``.

Null or empty texts and texts without words have an empty set and are linked with nothing. Rows that share a doc_id
are one document; a row with null doc_id takes the component of its equal sets, if any, else null. Texts are used whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakewright.llm.common import only
from lakewright.operators.components import connected_components
from lakewright.storage import cut, shuffle_width

#: Shingles that a block holds about, and those of the documents that are sought in one block together.
BLOCK, SOUGHT = 16_000, 400_000
#: Classes of the sample that shows frequent shingles, on how many of them a shingle is frequent, most such shingles.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 20, 200_000
#: Documents of the largest component, and of each other one, that meet first.
PIVOTS, ASKING = 64, 4
#: Candidate documents up to which their ids are broadcast (8 bytes each); classes that a task remembers.
FEW, REMEMBERED = 500_000, 1_000_000
#: Shingles of a prefix beyond those that may differ, as a multiple of these: to find candidates, and to group them.
MORE = 1, 3
#: Most 64-bit words of a sketch; words, and as many for each sketch besides, of the sketches that are compared together.
MOST_WORDS, COMPARED, BESIDE = 256, 16_384, 8
#: DivideSkip's weight of a long list's binary search against heap steps.
MU = 0.0085

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


_KEYS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles."""
    b = _LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    word = ~_BLANK[b]
    if not word.any():
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    length = end - start
    b = b[word].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(length) - length
    place = np.arange(len(b)) - np.repeat(first, length)
    if len(_KEYS) <= place.max():
        key = mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    else:
        key = _KEYS[place]
    w = mix(np.add.reduceat(b * key, first) + length.astype(np.uint64))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of a set's counts by the low bits of its shingles, in words: as many bits as shingles about."""
    words = 1
    while words < MOST_WORDS and 64 * words < len(s):
        words *= 2
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differ(a: Column, b: Column) -> Column:
    """How many shingles at least are in one of two sets only, by their sketches: the bits that differ, the longer one folded."""
    xor = lambda x, y: x.bitwiseXOR(y)
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda n, w: n + F.bit_count(w))
    half = lambda x: (F.size(x) / 2).cast("int")
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), xor)
    long = F.when(F.size(a) == 2 * F.size(b), bits(fold(a), b)).when(F.size(b) == 2 * F.size(a), bits(a, fold(b)))
    return F.when(F.size(a) == F.size(b), bits(a, b)).otherwise(F.coalesce(long, F.lit(0)))


def likely_pairs(left: pd.DataFrame, right: pd.DataFrame, num: int, den: int, nearest: bool) -> pd.DataFrame:
    """(i, j, d): rows of ``left`` and ``right`` (doc_id, label, n, sketch; right's main) whose sketches differ in d bits and allow a link.

    Of two rows of one label none; of two rows outside main one way round. ``nearest``: of each row of ``left`` only the pair
    with the least d, either way round.
    """
    out = [np.zeros((3, 0), np.int64)]
    doc, label, main = (right[c].to_numpy() for c in ("doc_id", "label", "main"))
    sides = []
    for df in (left, right):
        wide, n = df["sketch"].map(len).to_numpy(), df["n"].to_numpy()
        at = [np.flatnonzero(wide == w) for w in np.unique(wide)]
        at = [a[np.argsort(n[a], kind="stable")] for a in at]
        sides.append((n, [(a, np.stack(df["sketch"].to_numpy()[a]).view(np.uint64)) for a in at]))
    (n, lefts), (m, rights) = sides
    for (a, x), (b, y) in ((p, q) for p in lefts for q in rights):
        words = min(x.shape[1], y.shape[1])
        x, y = (np.bitwise_xor.reduce(z.reshape(len(z), -1, words), axis=1) for z in (x, y))  # the longer ones folded
        y = np.ascontiguousarray(y.T)
        for lo in range(0, len(a), 64):
            i = a[lo : lo + 64]
            first = np.searchsorted(m[b] * den, n[i[0]] * num)
            last = np.searchsorted(m[b] * num, n[i[-1]] * den, "right")
            if first >= last:
                continue
            j = b[first:last]
            d = np.zeros((len(i), len(j)), np.int32)
            for w in range(words):
                d += np.bitwise_count(x[lo : lo + 64, w, None] ^ y[w, None, first:last])
            both = n[i][:, None] + m[j][None]
            ok = d <= both + 2 * (-both * num // (num + den))
            ok &= (m[j][None] * den >= n[i][:, None] * num) & (m[j][None] * num <= n[i][:, None] * den)
            ok &= left["label"].to_numpy()[i][:, None] != label[j][None]
            if not nearest:
                ok &= (label[j] == main[j])[None] | (left["doc_id"].to_numpy()[i][:, None] < doc[j][None])
            u, v = np.nonzero(ok)
            out.append(np.stack([i[u], j[v], d[u, v]]))
    found = pd.DataFrame(np.concatenate(out, axis=1).T, columns=["i", "j", "d"])
    if nearest:
        found["doc"] = doc[found["j"]]
        found = found.sort_values(["i", "d", "doc", "j"]).drop_duplicates("i").drop(columns="doc")
    return found


def key(s: np.ndarray, salt: int) -> int:
    """A 64-bit hash of a set: the sum of its shingles' salted hashes; 0 for the empty set."""
    return int(np.add.reduce(mix(s + np.uint64(salt)), dtype=np.uint64).astype(np.uint64).view(np.int64)) if len(s) else 0


class Block:
    """Inverted lists of some sets, searched by T-occurrence."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, self.doc = tokens[order], doc[order]
        self.tokens, self.start = np.unique(tokens, return_index=True)
        self.end = np.append(self.start[1:], len(tokens))

    def search(self, q: np.ndarray, num: int, den: int, skip: np.ndarray) -> np.ndarray:
        """Documents of the block whose Jaccard with ``q`` is num / den or more, but for those in ``skip``."""
        n = len(q)
        at = np.searchsorted(self.tokens, q)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == q)] if len(self.tokens) else at[:0]
        need = -(-n * num // den)  # least overlap with any partner
        if len(at) < need:
            return np.zeros(0, np.int64)
        lists = at[np.argsort(self.start[at] - self.end[at], kind="stable")]  # longest first
        most = int(self.end[lists[0]] - self.start[lists[0]])
        long = min(need - 1, int(need / (MU * np.log2(max(most, 2)) + 1)))
        short, long_lists = lists[long:], lists[:long]
        found, hits = self._merge(short, need - long)
        keep = ~skip[found] & (self.sizes[found] * den >= n * num) & (self.sizes[found] * num <= n * den)
        found, hits = found[keep], hits[keep]
        for lo in range(0, len(found), 512):  # probes of bounded size
            part = found[lo : lo + 512]
            hits[lo : lo + 512] += self._probe(long_lists, part)
        return found[den * hits >= num * (n + self.sizes[found] - hits)]

    def _merge(self, lists: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents on ``least`` or more of the lists, and on how many, by a heap over the lists' heads."""
        heap = [(int(self.doc[self.start[t]]), int(self.start[t]), int(self.end[t])) for t in lists]
        heapq.heapify(heap)
        docs, counts = [], []
        while len(heap) >= least and heap:
            top, n = heap[0][0], 0
            while heap and heap[0][0] == top:
                _, i, end = heap[0]
                n += 1
                if i + 1 < end:
                    heapq.heapreplace(heap, (int(self.doc[i + 1]), i + 1, end))
                else:
                    heapq.heappop(heap)
            if n >= least:
                docs.append(top)
                counts.append(n)
        return np.array(docs, np.int64), np.array(counts, np.int64)

    def _probe(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """On how many of the lists each document is: a binary search in each list, for all pairs at once."""
        lo = np.repeat(self.start[lists][:, None], len(docs), 1)
        hi = np.repeat(self.end[lists][:, None], len(docs), 1)
        end = hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) // 2
            less = (self.doc[np.minimum(mid, len(self.doc) - 1)] < docs) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        return ((lo < end) & (self.doc[np.minimum(lo, len(self.doc) - 1)] == docs)).sum(0) if len(lists) else np.zeros(len(docs), np.int64)


def _check(num: int, den: int) -> None:
    if not 0 < num <= den:
        raise ValueError(f"the least Jaccard {num}/{den} is not in (0, 1]")


def _more(size: int, num: int, den: int, times: int) -> int:
    """How many shingles a prefix holds beyond those that may differ; grows with the size."""
    return max(1, min(-(-size * num // den), times * size * (den - num) // den))


def prefix_length(size: int, num: int, den: int, times: int = MORE[0]) -> int:
    """Shingles of a set's prefix, in the order of the hashes; 0 if only an equal set can be linked."""
    least = -(-size * num // den)  # least overlap with any partner
    if not size or least == size and size * den // num == size:
        return 0
    return size - least + _more(size, num, den, times)


def floor_of(size: Column, num: int, den: int, times: int = MORE[0]) -> Column:
    """Least number of prefix shingles that a set shares with any partner: its smallest partner's ``_more``."""
    small = F.ceil(size * num / den)
    return F.greatest(F.lit(1), F.least(F.ceil(small * num / den), F.floor(small * times * (den - num) / den)))


def links_within(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all documents of a block which links connect.

    Documents with equal ``labels`` are connected already. A link between documents that others connect may be left out.
    """
    block, group, out = Block(sets), labels.copy(), []
    for i in range(len(ids)):
        if (group == group[i]).all():
            continue
        for j in block.search(sets[i], num, den, group == group[i]):
            out.append((int(ids[i]), int(ids[j])))
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
    return out


def links_between(left: pd.DataFrame, right: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """One link at least between any two labels that links from ``left`` (doc_id, label, s) to ``right`` connect."""
    block, out = Block(list(right["s"])), []
    ids, label = right["doc_id"].to_numpy(), right["label"].to_numpy()
    own = {x: x for x in left["label"]}
    near = {x: {x} for x in own}  # labels that are known to be connected
    for i, mine, s in zip(left["doc_id"], left["label"], left["s"], strict=True):
        for j in block.search(s, num, den, np.isin(label, list(near[mine]))):
            if label[j] not in near[mine]:
                out.append((int(i), int(ids[j])))
                near[mine].add(label[j])
    return out


def classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, k1, k2, prefix) of every row; (node, n_shingles, k1, k2) of each class of equal, non-empty sets.

    A task gives the prefix of a class once, so copies don't repeat it.
    """
    none = np.zeros(0, np.int64)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part, out = pdf.iloc[at : at + 1000], []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    s = shingle_set(text, n)
                    k = key(s, 77), key(s, 99991)
                    new = k not in seen
                    if new and len(seen) < REMEMBERED:
                        seen.add(k)
                    out.append((doc_id, len(s), *k, s[: prefix_length(len(s), num, den)].view(np.int64) if new else none))
                yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "k1", "k2", "prefix"])

    # ids travel as text: pandas would make floats of ids beside nulls
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    made = rows.mapInPandas(tokens, "doc_id string, n_shingles long, k1 long, k2 long, prefix array<long>")
    base = cut(made.withColumn("doc_id", F.col("doc_id").cast("long")), "sets")
    whole = base.where("n_shingles > 0 and doc_id is not null")
    reps = whole.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"))
    return base, cut(reps, "reps")


def _frequent(sets: DataFrame, shingles: str) -> DataFrame:
    """(sig, hot): the shingles that are on many of a bounded sample of (id, shingles); at most MOST_FREQUENT rows."""
    step = max(1, sets.count() // SAMPLE)
    some = sets.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(step)) == 0).select("id", F.explode(shingles).alias("sig"))
    n = some.groupBy("sig").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    n = n.where((F.col("n") >= FREQUENT) & (F.col("lo") != F.col("hi")))
    return cut(n.orderBy(F.desc("n"), "sig").limit(MOST_FREQUENT).select("sig", F.lit(True).alias("hot")), "frequent")


def _marked(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows (sig, id, ...) with hot, and deal: frequent shingles are dealt by set, the others by shingle alone."""
    rows = rows.join(F.broadcast(frequent), "sig", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    return rows.withColumn("deal", F.when(F.col("hot"), F.col("id")).otherwise(F.lit(0)))


def _beside(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (sig, deal, id, n, hot) with ``before``: the next smaller set of the list, if the sizes allow a link; and ``shared``."""
    by = Window.partitionBy("sig", "deal").orderBy("n", "id")
    fits = lambda small, large: large * num <= small * den
    near = rows.select(
        "*",
        F.lag("id").over(by).alias("i0"),
        F.lag("n").over(by).alias("n0"),
        F.lead("id").over(by).alias("i1"),
        F.lead("n").over(by).alias("n1"),
    )
    low = (F.col("i0") != F.col("id")) & fits(F.col("n0"), F.col("n"))
    high = (F.col("i1") != F.col("id")) & fits(F.col("n"), F.col("n1"))
    near = near.withColumn("before", F.when(low, F.col("i0")))
    return near.withColumn("shared", F.col("hot") | F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False)))


def candidates(base: DataFrame, num: int, den: int) -> DataFrame:
    """(id): classes (by k1) that share enough prefix shingles to have partners."""
    sets = base.select(F.col("k1").alias("id"), F.col("n_shingles").alias("n"), "prefix")
    rows = _marked(sets.select(F.explode("prefix").alias("sig"), "id", "n"), _frequent(sets, "prefix"))
    for _ in range(2):
        near = _beside(rows, num, den).where("shared").select("sig", "deal", "id", "n", "hot")
        shared = cut(near.distinct(), "shared")  # dealt as the window is: no shuffle
        counts = shared.groupBy("id", "n").agg(F.count("*").alias("c"))
        able = cut(counts.where(F.col("c") >= floor_of(F.col("n"), num, den)).select("id").distinct(), "able")
        rows = shared.join(able, "id", "left_semi")
    return able


def candidate_groups(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, component): candidates in groups that no link leaves; and (sig, id, n, hot): the lists, one of which any partners share.

    Longer prefixes, whose shingles are ordered by how many candidates hold them, the rarest first. A set with c shingles that
    others hold, of which it shares m or more with any partner, shares one of the rarest c - m + 1 with it. A common passage
    comes last there, so it ties only sets that hold little else.
    """
    rows = sets.select("id", "n", F.explode("wide").alias("sig"))
    by = Window.partitionBy("sig", "deal")
    held = _marked(rows, _frequent(sets, "wide")).withColumn("f", F.count("*").over(by)).where((F.col("f") > 1) | F.col("hot"))
    inside = Window.partitionBy("id")
    ordered = inside.orderBy("hot", "f", "sig")
    held = held.withColumn("new", F.coalesce(F.lag("sig").over(ordered) != F.col("sig"), F.lit(True)).cast("int"))
    held = held.withColumn("r", F.dense_rank().over(ordered)).withColumn("c", F.sum("new").over(inside))
    kept = held.where((F.col("new") == 1) & (F.col("r") <= F.col("c") - floor_of(F.col("n"), num, den, MORE[1]) + 1))
    left = _beside(kept.select("sig", "deal", "id", "n", "hot"), num, den).where("shared")
    left = cut(left.select("sig", "id", "n", "hot", "before"), "lists")
    # along a list each set is tied to the one before it; a frequent shingle ties its sets by its own name
    edges = left.select(F.col("id").alias("src"), F.when(F.col("hot"), F.col("sig")).otherwise(F.col("before")).alias("dst"))
    return connected_components(edges.where("dst is not null").distinct()).withColumnRenamed("node", "id"), left.drop("before")


def _spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows dealt by key to a fixed number of tasks: bytes don't tell how long a search takes, so they aren't coalesced."""
    return df.repartition(max(shuffle_width(df.sparkSession), min(tasks, 20_000)), *keys)


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; documents link when den * overlap >= num * union."""
    _check(num, den)
    base, reps = classes(docs, n, num, den)
    named = reps.select("node", F.col("k1").alias("id"))
    wanted = cut(candidates(base, num, den).join(named, "id"), "wanted").withColumnRenamed("node", "doc_id")
    texts = only(docs, "doc_id", "text").join(_few(wanted), "doc_id")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                made = [shingle_set(t, n) for t in part["text"]]
                out = pd.DataFrame({"doc_id": part["doc_id"], "id": part["id"], "n": [len(s) for s in made]})
                out["s"] = [s.view(np.int64) for s in made]
                out["wide"] = [s[: prefix_length(len(s), num, den, MORE[1])].view(np.int64) for s in made]
                out["sketch"] = [sketch(s) for s in made]
                # of rows that share a doc_id each stands for its own class
                yield out[[key(s, 77) == i for s, i in zip(made, part["id"], strict=True)]]

    sets = cut(texts.mapInPandas(to_sets, "doc_id long, id long, n long, s array<long>, wide array<long>, sketch array<long>"), "sets")
    groups, lists = candidate_groups(sets, num, den)
    members = cut(sets.select("doc_id", "id", "n").distinct().join(groups, "id"), "members")
    load = members.groupBy("component").agg(F.sum("n").alias("load")).where(F.col("load") > BLOCK)  # few: the others have one block
    members = members.join(_few(cut(load, "loads")), "component", "left")
    members = members.withColumn("chunks", F.coalesce(F.ceil(F.col("load") / BLOCK).cast("int"), F.lit(1)))
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    members = cut(members.select("doc_id", "id", "n", "component", "chunks", chunk.alias("chunk")), "members")
    tasks = int((members.agg(F.sum("n")).first()[0] or 0) // (4 * BLOCK)) + 1
    sets = sets.select("doc_id", "id", "s", "sketch").join(_few(members), ["doc_id", "id"])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "id"]).sort_values(["doc_id", "id"]).reset_index(drop=True)
        data = [x.view(np.uint64) for x in pdf["s"]]
        found = links_within(pdf["doc_id"].to_numpy(), data, np.arange(len(pdf)), num, den)
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    blocks = _spread(sets.drop("sketch"), tasks, "component", "chunk").groupBy("component", "chunk")
    links = cut(blocks.applyInPandas(within, "src long, dst long"), "links")
    if members.where("chunks > 1").take(1):
        links = across(sets.where("chunks > 1"), members.where("chunks > 1"), lists, links, num, den)
    label = connected_components(links)
    component = F.coalesce("component", "node").alias("component_id")
    nodes = reps.select("k1", "k2", "node").join(label, "node", "left").select("k1", "k2", component)
    keyed = base.select("doc_id", "n_shingles", "k1", "k2").join(nodes, ["k1", "k2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return keyed.select("doc_id", "n_shingles", own.alias("component_id"))


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if the rows, counted first, are FEW: then a group of many rows needn't be dealt to one task."""
    return F.broadcast(df) if df.count() <= FEW else df


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with label and main: the group's largest label."""
    label = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    known = members.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    size = known.groupBy("component", "label").agg(F.count("*").alias("k"))
    most = size.groupBy("component").agg(F.max(F.struct("k", "label")).alias("m"))
    most = cut(most.select("component", F.col("m.label").alias("main")), "main")
    return cut(known.join(_few(most), "component"), "labels")


def across(large: DataFrame, members: DataFrame, lists: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """``links`` and links between different blocks of one candidate group.

    First a few documents of each label meet a few of the group's largest: a family whose blocks are connected inside falls
    together. Of any two documents that are not yet connected one at least is outside the largest label. Those that share a shingle
    of ``lists`` with a document of another label, and whose sketches don't rule a link out, are searched for among these alone. Sets
    that are on the list of a frequent shingle, which would make too many pairs, compare their sketches alone, block by block; sets
    are sent where these allow a link: of each document to the nearest first, which joins most, then to all of another label.
    ``members``: the keys of ``large``.
    """

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "id", "asks"]).sort_values(["doc_id", "id"]).reset_index(drop=True)
        pdf["s"] = [x.view(np.uint64) for x in pdf["s"]]
        asks = pdf["asks"].to_numpy(bool)
        found = links_between(pdf[asks], pdf[~asks], num, den) if asks.any() and not asks.all() else []
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    at = ["doc_id", "id", "component"]

    def met(sought: DataFrame, held: DataFrame, tasks: int) -> DataFrame:
        """Links between documents that are sought and those held, by (component, part, chunk)."""
        told = sought.withColumn("asks", F.lit(True)).unionByName(held.withColumn("asks", F.lit(False)))
        told = told.groupBy(*at, "label").agg(F.collect_list(F.struct("part", "chunk", "asks")).alias("to"))
        told = cut(told, "told")
        entries = told.agg(F.sum(F.size("to"))).first()[0] or 0
        sent = large.select(*at, "s").join(F.broadcast(told) if entries <= FEW else told, at)
        sent = sent.select(*at, "label", "s", F.inline("to"))
        groups = _spread(sent, tasks, "component", "part", "chunk").groupBy("component", "part", "chunk")
        return cut(groups.applyInPandas(search, "src long, dst long"), "links")

    def parts(sought: DataFrame) -> DataFrame:
        """``sought`` with a part, and each group's number of parts."""
        n = sought.groupBy("component").agg(F.ceil(F.sum("n") / SOUGHT).cast("int").alias("parts"))
        return sought.join(_few(cut(n, "parts")), "component").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int"))

    def settled(pairs: DataFrame) -> DataFrame:
        """Links of ``pairs`` (doc_id, id, component, label, n; those asked for: the same with 2, and m)."""
        # those asked for are dealt to blocks, of which one takes a bounded number of those that ask
        block = cut(pairs.select(*[f"{c}2" for c in at], "m").distinct().groupBy("component2").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks")), "blocks")
        pairs = pairs.join(_few(block), "component2").withColumn("chunk", F.pmod(F.xxhash64("label2"), F.col("blocks")).cast("int"))
        load = pairs.select(*at, "n", "chunk").distinct().groupBy("component", "chunk").agg(F.ceil(F.sum("n") / SOUGHT).cast("int").alias("parts"))
        pairs = pairs.join(_few(cut(load, "parts")), ["component", "chunk"])
        pairs = cut(pairs.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int")), "asked")
        asks = pairs.select(*at, "label", "part", "chunk").distinct()
        asked = pairs.select(*[F.col(f"{c}2").alias(c) for c in [*at, "label"]], "part", "chunk").distinct()
        return met(asks, asked, asks.select("component", "part", "chunk").distinct().count() // 4 + 1)

    def compared(sought: DataFrame, known: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of ``sought`` and ``known`` whose sketches allow a link: each block of sketches meets each of its component."""
        blocks = F.ceil(F.sum(F.size("sketch") + BESIDE) / COMPARED).cast("int")
        size = [df.groupBy("component").agg(blocks.alias(to)) for df, to in ((sought, "parts"), (known, "chunks"))]
        size = cut(size[0].join(size[1], "component"), "blocks")
        here = [*at, "label", "main", "n", "sketch"]
        sides = []
        for df, own, other in ((sought, "part", "chunk"), (known, "chunk", "part")):
            df = df.select(*here).join(_few(size), "component")
            df = df.withColumn(own, F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col(f"{own}s")).cast("int"))
            df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            sides.append(df.select(*here, "part", "chunk", F.lit(own == "part").alias("asks")))

        def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.drop_duplicates(["doc_id", "id", "asks"])
            left, right = (pdf[side].sort_values(["doc_id", "id"]).reset_index(drop=True) for side in (pdf["asks"], ~pdf["asks"]))
            found = likely_pairs(left, right, num, den, nearest)
            one, two = left.iloc[found["i"]].reset_index(drop=True), right.iloc[found["j"]].reset_index(drop=True)
            out = one[[*at, "label", "n"]].assign(doc_id2=two["doc_id"], id2=two["id"], label2=two["label"], m=two["n"], d=found["d"].to_numpy())
            return out.assign(component2=out["component"])

        tasks = size.agg(F.sum(F.col("parts").cast("long") * F.col("chunks"))).first()[0] or 0
        groups = _spread(sides[0].unionByName(sides[1]), tasks, "component", "part", "chunk").groupBy("component", "part", "chunk")
        kinds = ", ".join(f"{c} long" for c in [*at, "label", "n", "doc_id2", "id2", "label2", "m", "d", "component2"])
        pairs = groups.applyInPandas(compare, kinds)
        if nearest:
            other = ["doc_id2", "id2", "component2", "label2", "m"]
            best = pairs.groupBy(*at, "label", "n").agg(F.min(F.struct("d", *other)).alias("b"))
            pairs = best.select(*at, "label", "n", *[f"b.{c}" for c in other])
        return cut(pairs.drop("d"), "likely")

    # a few of each label against a few of the largest
    known = _labelled(members, links)
    order = Window.partitionBy("component", "label").orderBy(F.xxhash64("doc_id"), "doc_id")
    rank = known.withColumn("r", F.row_number().over(order))
    some = parts(rank.where((F.col("label") != F.col("main")) & (F.col("r") <= ASKING)))
    pivots = rank.where((F.col("label") == F.col("main")) & (F.col("r") <= PIVOTS))
    pivots = pivots.join(_few(cut(some.select("component", "part").distinct(), "parts")), "component")
    keep = [*at, "label", "part", F.lit(0).alias("chunk")]
    links = links.union(met(some.select(*keep), pivots.select(*keep), 1))

    # what is still outside the largest label against the documents of its lists
    known = _labelled(members, links).select(*at, "n", "label", "main")
    if not known.where(F.col("label") != F.col("main")).take(1):
        return links
    fits = F.expr(f"n * {num} <= m * {den} and m * {num} <= n * {den}")
    on = lists.where("not hot").select("sig", "id").join(known, "id")
    ask = on.where(F.col("label") != F.col("main"))
    there = on.select("sig", *[F.col(c).alias(f"{c}2") for c in [*at, "label", "main"]], F.col("n").alias("m"))
    new = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("main2")) | (F.col("doc_id") < F.col("doc_id2")))
    pairs = ask.join(there, "sig").where(new & fits).drop("sig").dropDuplicates([*at, "doc_id2", "id2"])
    held = large.select("doc_id", "id", "sketch")
    pairs = pairs.join(held, ["doc_id", "id"]).join(held.toDF("doc_id2", "id2", "sketch2"), ["doc_id2", "id2"])
    most = F.col("n") + F.col("m") - 2 * F.ceil((F.col("n") + F.col("m")) * num / (num + den))
    pairs = cut(pairs.where(differ(F.col("sketch"), F.col("sketch2")) <= most).drop("sketch", "sketch2"), "pairs")
    links = links.union(settled(pairs))

    # sets on frequent lists: first the nearest of each by sketches, then all that sketches allow between what is still apart
    often = lists.where("hot").select("id").distinct()
    often = cut(members.join(often, "id", "left_semi").join(large.select("doc_id", "id", "sketch"), ["doc_id", "id"]), "often")
    for nearest in (True, False):
        known = _labelled(often, links)
        sought = known.where(F.col("label") != F.col("main"))
        if not sought.take(1):
            return links
        links = links.union(settled(compared(sought, known, nearest)))
    return links
