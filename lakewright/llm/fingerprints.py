"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its lines. Each line hashes to a wide vector: ``LANES`` uniform 16-bit lanes, and ``SKETCH``
lanes that hold a signed count of the line's 16-byte windows. A text's fingerprint is the sum of its lines' vectors modulo
2^16 and 2^24. So it does not depend on the order of lines, and lines are put in or taken out by adding or
subtracting their vectors. Equality is that of the uniform lanes; the signed lanes are a linear sketch, and the cosine of
two of them estimates the likeness of the texts' windows.

Null text counts as empty, one empty line. Texts are hashed whole. Repeated rows have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lakewright.llm.common import only
from lakewright.storage import cut, shuffle_width

#: Uniform lanes of 16 bits, sketch lanes of 24 bits, bytes a window.
LANES, SKETCH, WINDOW = 64, 256, 16
#: Characters a range of documents, most ranges, rows of the sample that sets the ranges' ends.
RANGE, MOST_RANGES, SAMPLE = 6_000_000, 50_000, 200_000


def _sketch(raw: bytes) -> np.ndarray:
    """Signed counts of the windows that start at each byte of each line, the line's end filled with zeros."""
    if not raw:
        return np.zeros(SKETCH, np.int64)
    padded = np.frombuffer(raw.replace(b"\n", b"\0" * WINDOW) + b"\0" * WINDOW, np.uint8)
    words = np.lib.stride_tricks.as_strided(padded.view(), (len(padded) - WINDOW + 1, WINDOW), (1, 1), writeable=False)[padded[: len(padded) - WINDOW + 1] != 0]
    both = np.ascontiguousarray(words).view(np.uint64)
    h = (both[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (both[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + (both[:, 1] >> np.uint64(31)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    lane = (h >> np.uint64(55)).astype(np.int64)  # 8 bits of lane and one of sign
    counts = np.bincount(lane, minlength=2 * SKETCH)
    return counts[:SKETCH] - counts[SKETCH:]


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(uniform lanes modulo 2^16, signed sketch) of a text: the sum over its lines."""
    raw = (text or "").encode("utf-8", "replace")
    digests = b"".join(hashlib.shake_128(line).digest(2 * LANES) for line in raw.split(b"\n"))
    return np.frombuffer(digests, "<u2").reshape(-1, LANES).sum(0, dtype=np.uint64).astype(np.uint16), _sketch(raw)


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint with the lines of ``b`` put in, or with sign -1 taken out."""
    return ((a[0].astype(np.int64) + sign * b[0].astype(np.int64)) % (1 << 16)).astype(np.uint16), a[1] + sign * b[1]


def encode(v: tuple[np.ndarray, np.ndarray]) -> str:
    """Lanes in hex, then the sketch modulo 2^24 in base64."""
    low = (v[1] % (1 << 24)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return v[0].astype("<u2").tobytes().hex() + "." + base64.b64encode(low.tobytes()).decode()


def decode(s: str) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``encode``; sketch lanes from -2^23 to 2^23 - 1."""
    lanes, low = s.split(".")
    raw = np.frombuffer(base64.b64decode(low), np.uint8).reshape(-1, 3).astype(np.int64)
    x = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
    return np.frombuffer(bytes.fromhex(lanes), "<u2"), np.where(x >= 1 << 23, x - (1 << 24), x)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, else the sketches' cosine, from 0 to 1; a function of the fingerprint strings."""
    x, y = (_signed(v[1]) for v in (a, b))
    if (a[0] == b[0]).all() and (x == y).all():
        return 1.0
    x, y = x.astype(float), y.astype(float)
    n = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, (x @ y) / n))) if n else 0.0


def _signed(x: np.ndarray) -> np.ndarray:
    """Sketch lanes modulo 2^24, from -2^23 to 2^23 - 1."""
    return (x + (1 << 23)) % (1 << 24) - (1 << 23)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with fingerprint string."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(vector(t)) for t in texts])

    return docs.withColumn("fingerprint", of(docs["text"]))


def _ends(rows: DataFrame) -> list[tuple[int, int]]:
    """Last (doc_id, hash) of each range but the last, in the order of the rows: from a sample of about SAMPLE rows."""
    facts = rows.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).first()
    want = max(shuffle_width(rows.sparkSession), -(-int(facts.chars or 0) // RANGE))
    width = max(1, min(facts.n, want, MOST_RANGES))
    step = max(1, facts.n // SAMPLE)
    some = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    some = some.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(step)) == 0)
    keys = sorted(((r.doc_id, r.h) for r in some.limit(4 * SAMPLE).collect()), key=lambda k: (-k[0], k[1]))
    at = sorted({len(keys) * i // width for i in range(1, width)})
    return list(dict.fromkeys(keys[i] for i in at if i < len(keys)))


def _range(ends: list[tuple[int, int]]) -> Column:
    """How many ends lie before a row (doc_id, h) in the order of the rows: a binary search in one literal; null ids are last."""
    if not ends:
        return F.lit(0)
    table = [F.split(F.lit(",".join(str(e[k]) for e in ends)), ",").cast("array<long>") for k in (0, 1)]

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        i, h = F.get(table[0], mid), F.get(table[1], mid)
        less = (i > F.col("doc_id")) | ((i == F.col("doc_id")) & (h < F.col("h")))
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~less, mid).otherwise(s["hi"]).alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi"))
    rounds = F.array(*[F.lit(0)] * (len(ends).bit_length() + 1))
    return F.when(F.col("doc_id").isNull(), F.lit(len(ends))).otherwise(F.aggregate(rounds, whole, step, lambda s: s["lo"]))


def in_ranges(docs: DataFrame) -> DataFrame:
    """(range, guest, doc_id, h, text): rows dealt to ranges of the order, and sorted in them.

    The order is that of descending doc_id, nulls last, then of the text's hash, so repeated ids are split too. A range ends with
    its guest, the first row of the next range that has rows; the last range's guest is the first row of all. One shuffle of
    the texts; a range holds about RANGE characters until there are MOST_RANGES.
    """
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    ends = _ends(rows)
    dealt = rows.withColumn("range", _range(ends))
    # each range's first key: one row a range, of which there are MOST_RANGES at most
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.bitwise_not("doc_id").alias("d"), "h")
    firsts = dealt.groupBy("range").agg(F.min(place).alias("k")).orderBy("range").collect()
    before = [(r.range, firsts[i - 1].range, None if r.k.z else ~r.k.d, r.k.h) for i, r in enumerate(firsts)]
    told = spark.createDataFrame(before, "range int, to int, i long, first long")
    same = (dealt["range"] == told["range"]) & dealt["doc_id"].eqNullSafe(told["i"]) & (dealt["h"] == told["first"])
    guests = dealt.join(F.broadcast(told), same).select(F.col("to").alias("range"), "doc_id", "h", "text")
    # of rows that repeat a first key one is a guest
    guests = cut(guests.groupBy("range").agg(F.min(F.struct("doc_id", "h", "text")).alias("g")), "guests")
    guests = guests.select("range", F.lit(True).alias("guest"), "g.doc_id", "g.h", "g.text")
    both = dealt.select("range", F.lit(False).alias("guest"), "doc_id", "h", "text").unionByName(guests)
    both = both.repartition(max(1, len(firsts)), "range")
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("text").asc_nulls_first()]
    return both.sortWithinPartitions("range", "guest", *order)


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last n_chars // 2 code points replaced by the first as many of the next document's, in descending
    doc_id order, nulls last, ties by the text's hash (xxhash64), then by text. The first document follows the last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row whose next is awaited: (range, doc_id, text, vector)
        for pdf in batches:
            out = []
            for rng, guest, doc_id, text in zip(pdf["range"], pdf["guest"], pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                if held is not None and held[0] != rng:
                    raise ValueError("a range ended without its guest")
                if held is None and guest:
                    continue
                v = held[3] if held is not None and held[2] == text else vector(text)  # repeated rows are hashed once
                if held is not None:
                    _, hid, htext, hv = held
                    half = len(htext) // 2
                    edited = htext[: len(htext) - half] + text[:half]
                    ev = vector(edited)
                    out.append((hid, len(htext), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), encode(hv), encode(ev), likeness(hv, ev), likeness(hv, v)))
                held = None if guest else (rng, doc_id, text, v)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows = in_ranges(docs).withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of ids beside nulls
    made = rows.mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
