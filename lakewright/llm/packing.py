"""Best-fit packing into sequences of several permitted lengths.

Texts are counted in words. A text longer than the largest length is cut into pieces of that length and a rest, so
whole texts are packed. Pieces are dealt to shards of about ``SHARD`` pieces by a hash; a shard's pieces are placed by
decreasing length, each in the open bin with the least room that holds it. If there is none, a bin opens: pieces of one size class (those
of one least permitted length) open bins of one length, and the classes' lengths are optimised jointly. From the best single
length on, one class at a time takes the length that lowers the shard's cost the most, until none does; the cost is that of
all bins once each has shrunk to the least permitted length that holds its contents. A sequence costs its length, an
overhead, and a share of its length's square, as attention does, so that neither the largest nor the least length always wins.

Null texts and texts without words have length 0 and get a row with null bin. Reruns agree. Repeated rows are packed
one by one. Empty input gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lakewright.llm.common import only, word_count
from lakewright.storage import cut

#: Permitted sequence lengths, the overhead of a sequence, the weight of its squared length, pieces a shard.
LENGTHS, OVERHEAD, SQUARE, SHARD = (256, 512, 1024, 2048, 4096), 16, 1 / 16384, 4096


def cost(length: int, overhead: int = OVERHEAD, square: float = SQUARE) -> float:
    """What a sequence of a permitted length costs."""
    return length + overhead + square * length * length


def place(sizes: list[int], opens: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset, words in each bin) by best fit; ``opens``: the length that a size class opens.

    ``sizes`` decrease; ``lengths`` increase.
    """
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for i, n in enumerate(sizes):
        k = bisect_left(room, (n, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = opens[bisect_left(lengths, n)], len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        if left > n:
            insort(room, (left - n, b))
    return where, offset, used


def pack(
    sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, square: float = SQUARE
) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset, permitted length of each bin) for pieces no longer than the largest length."""
    lengths = tuple(sorted(set(lengths)))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ordered = [sizes[i] for i in order]
    price = [cost(c, overhead, square) for c in lengths]
    total = lambda opens: sum(price[bisect_left(lengths, u)] for u in place(ordered, opens, lengths)[2])
    least, opens = min((total(o), o) for o in ([max(c, k) for k in lengths] for c in lengths))
    present = sorted({bisect_left(lengths, n) for n in ordered}, reverse=True)
    while True:
        tried = [[*opens[:c], length, *opens[c + 1 :]] for c in present for length in lengths[c:] if length != opens[c]]
        found, better = min(((total(o), o) for o in tried), default=(least, opens))
        if found >= least - 1e-9:
            break
        least, opens = found, better
    at, start, used = place(ordered, opens, lengths)
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for i, b, k in zip(order, at, start, strict=True):
        where[i], offset[i] = b, k
    return where, offset, [lengths[bisect_left(lengths, u)] for u in used]


def packed(
    docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD, square: float = SQUARE
) -> DataFrame:
    """(doc_id, piece, start, n_words, bin_id, bin_length, bin_offset): one row a piece of a document.

    ``start`` is the piece's first word in its document; ``bin_id`` names shard and bin.
    """
    top = max(lengths)
    # ids travel as text: pandas would make floats of ids beside nulls
    rows = only(docs, "doc_id", "text").select("doc_id", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("h"))
    count = F.greatest(F.lit(1), F.ceil(F.col("words") / top)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("start", (F.col("piece") * top).cast("long"))
    pieces = pieces.withColumn("n_words", F.least(F.lit(top).cast("long"), F.col("words") - F.col("start")))
    pieces = cut(pieces.select(F.col("doc_id").cast("string"), "piece", "start", "n_words", "h"), "pieces")
    full = pieces.where("n_words > 0")
    n = max(1, -(-full.count() // shard))
    full = full.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "h"), F.lit(n)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "h"], na_position="last").reset_index(drop=True)
        where, offset, size = pack(pdf["n_words"].tolist(), lengths, overhead, square)
        return pdf.assign(bin_id=[f"{s}-{b}" for s, b in zip(pdf["shard"], where, strict=True)], bin_length=[size[b] for b in where], bin_offset=offset)[["doc_id", "piece", "start", "n_words", "bin_id", "bin_length", "bin_offset"]]

    out = full.groupBy("shard").applyInPandas(place, "doc_id string, piece int, start long, n_words long, bin_id string, bin_length int, bin_offset int")
    none = pieces.where("n_words = 0").select("doc_id", "piece", "start", "n_words", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("bin_offset"))
    return out.union(none).withColumn("doc_id", F.col("doc_id").cast("long"))
