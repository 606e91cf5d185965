"""WARC archives: a writer through Spark's file commit, and a splittable reader.

Writer. Each record is one gzip member. Spark's text writer puts the members' raw bytes into the archive files, so
tasks that are lost or run twice leave nothing behind. That writer ends each row with a separator: here the zero byte, which
is the last byte of any member whose record is under 16 MiB (the top byte of its length). Larger records are
followed by an empty member, which ends so too.

Reader. Archives are cut into byte ranges. A task looks for the gzip magic in its range, takes a place for a member only if
its header decodes and the content starts as a WARC record, and owns the records that start inside, reading on past the range's end for
the last. Nothing but a range's start and end is needed, so ranges are retried freely.

Records with equal payloads of ``least`` bytes or more: the one with the smallest page_id is the response, the others are
revisits that refer to it. Rows that repeat that page_id are responses too; a null page_id is never a response's, unless
all are null, and is written as -. Null html is an empty payload. Large payloads stream through in pieces.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewright.llm.common import only
from lakewright.storage import scratch

#: Bytes a range, bytes a read, the gzip magic with its method.
SPLIT, READ, MAGIC = 4 << 20, 1 << 18, b"\x1f\x8b\x08"
_EMPTY = gzip.compress(b"", mtime=0)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, as a gzip member that ends with a zero byte.

    A revisit keeps its payload's length and digest but not the payload.
    """
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    name = "-" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = made.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + made.flush()
    return member if member[-1] == 0 else member + _EMPTY


def b32(sha1_hex: str) -> str:
    """A hex SHA-1 in upper-case base32."""
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the pages' records to archives under ``path``."""
    rows = only(pages, "page_id", "url", "html").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    marked = rows.join(groups, "sha", "left")
    marked = marked.withColumn("refers_to", F.when((F.length("payload") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    @F.pandas_udf("binary")
    def member(ids: pd.Series, urls: pd.Series, payloads: pd.Series, shas: pd.Series, refers: pd.Series) -> pd.Series:
        number = lambda x: None if x is None or x != x else int(x)
        return pd.Series([record(number(i), u, p, b32(s), number(r))[:-1] for i, u, p, s, r in zip(ids, urls, payloads, shas, refers, strict=True)])

    raw = marked.select(member(F.col("page_id").cast("string"), "url", "payload", "sha", F.col("refers_to").cast("string")).cast("string").alias("value"))
    raw.write.option("lineSep", "\0").option("compression", "none").text(path)


def ranges(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, start, stop) of all byte ranges of the archives under ``path``: a listing, no reading."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = [(f.getPath().toString(), f.getLen()) for f in at.getFileSystem(conf).listStatus(at) if not f.getPath().getName().startswith(("_", "."))]
    whole = spark.createDataFrame(files, "path string, size long").where("size > 0")
    cut = whole.select("path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / split))).alias("k"))
    cut = cut.select("path", (F.col("k") * split).alias("start"), F.least(F.col("size"), (F.col("k") + 1) * split).alias("stop"))
    n = sum(-(-size // split) for _, size in files)
    return cut.repartition(max(1, min(n, 10_000)), "path", "start")


def _is_record(file, at: int) -> bool:
    """Whether a gzip member that begins as a WARC record starts at ``at``: its first bytes are decoded."""
    file.seek(at)
    try:
        return zlib.decompressobj(31).decompress(file.read(512), 5) == b"WARC/"
    except zlib.error:
        return False


def _first(file, start: int, stop: int) -> int | None:
    """Where the first true member of [start, stop) begins."""
    at = start
    while at < stop:
        file.seek(at)
        window = file.read(min(READ, stop - at) + len(MAGIC) - 1)
        k = window.find(MAGIC)
        while 0 <= k and at + k < stop:
            if _is_record(file, at + k):
                return at + k
            k = window.find(MAGIC, k + 1)
        at += max(1, len(window) - len(MAGIC) + 1)
    return None


def members(file, start: int, stop: int) -> Iterator[bytes]:
    """Contents of the WARC members that start in [start, stop): one pass over the bytes, and past ``stop`` for the last."""
    at = _first(file, start, stop)
    if at is None:
        return
    file.seek(at)
    read, data = at, b""  # bytes read so far; those that no member has taken yet
    while at < stop:
        made, out, begin = zlib.decompressobj(31), [], at
        while not made.eof:
            if not data:
                data = file.read(min(READ, stop - read) if read < stop else 1 << 16)
                read += len(data)
                if not data:
                    raise ValueError(f"damaged member at byte {begin}")
            try:
                out.append(made.decompress(data))
            except zlib.error as e:
                raise ValueError(f"damaged member at byte {begin}") from e
            at += len(data) - len(made.unused_data)
            data = made.unused_data
        content = b"".join(out)
        if content:
            yield content


def parse(content: bytes) -> dict:
    """Header fields (lower case) and body of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields | {"body": rest[: int(fields["content-length"])]}


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of all records under ``path``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        number = lambda s: None if s in (None, "<urn:page:->") else s.removeprefix("<urn:page:").removesuffix(">")
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        for pdf in batches:
            for p, start, stop in zip(pdf["path"], pdf["start"], pdf["stop"], strict=True):
                store, name = fs.FileSystem.from_uri(p)
                out, held = [], 0
                with store.open_input_file(name) as file:
                    for content in members(file, start, stop):
                        r = parse(content)
                        body = r["body"]
                        digest, size = r["warc-payload-digest"].removeprefix("sha1:"), int(r["x-payload-length"])
                        if r["warc-type"] == "response":
                            if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != size:
                                raise ValueError(f"record {r['warc-record-id']}: payload and digest differ")
                        out.append((number(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], digest, size, number(r.get("warc-refers-to")), body))
                        held += len(body)
                        if held > 16 << 20 or len(out) >= 2000:
                            yield pd.DataFrame(out, columns=names)
                            out, held = [], 0
                yield pd.DataFrame(out, columns=names)

    rows = ranges(spark, path, split).mapInPandas(scan, "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back, without the payloads."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
