"""Queries of the corpus operators, and their SQL oracles."""

from __future__ import annotations

import importlib.util
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewright.llm import ann, chat, fingerprints, jaccard, language, licenses, mixing, packing, quality, warc
from lakewright.storage import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best licence, its Dice coefficient, and how many licences match."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("license_dice", 6).alias("dice"), F.size(F.array_distinct("license_hits.license")).cast("long").alias("n_licenses"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text."""
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is full of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], rows.schema))
    messages = chat.cut(chat.as_chain(rows), "messages")
    return chat.digests(chat.formatted(chat.paths(messages), messages))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality score of each document."""
    out = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "quality_score", "content_score", "metadata_score", "keep")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard of 0.9 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC archives and read back by byte ranges."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of permitted lengths."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, by mixture inference."""
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's stages, one after another, over all documents."""
    return _corpus_pipeline().run(spark, sf_dir)


def _corpus_pipeline():
    """The module at the repository's top, wherever Python was started."""
    if "corpus_pipeline" not in sys.modules:
        spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).parents[2] / "corpus_pipeline.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        sys.modules["corpus_pipeline"] = module
    return sys.modules["corpus_pipeline"]


def queries() -> dict:
    found = [op1_license_scan, op2_mix_sources, op3_fingerprints, op4_chat_format, op5_quality, op6_jaccard_join, op7_nearest, op8_warc, op9_packing, op10_language, pipeline]
    return {f.__name__: f for f in found}


def _license_sql() -> str:
    t = licenses.THRESHOLD
    rows = ", ".join(f"('{k}', {len(b)}, [{', '.join(repr(x) for x in b)}])" for k, b in licenses.templates(licenses.TEMPLATES))
    return f"""
with t(license, n, b) as (values {rows}),
p as (select doc_id, row_number() over () as r, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') as x from documents),
u as (select r, unnest(list_distinct(list_concat(string_split(x, chr(10)), list_transform(regexp_split_to_array(x, '\\n *\\n'), lambda y: replace(y, chr(10), ' ')), [replace(x, chr(10), ' ')]))) as u from p),
w as (select r, list_filter(string_split(u, ' '), lambda y: y <> '') as w from u),
a as (select r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as a from w where len(w) > 1),
d as (select r, license, 2.0::double * len(list_intersect(a, b)) / (len(a) + n) as dice from a join t on len(a) >= n * {t / (2 - t)!r}::double and len(a) <= n * {(2 - t) / t!r}::double),
h as (select r, min((-dice, license)) as best, count(distinct license) as k from d where dice >= {t} group by r)
select doc_id, best[2] as license, round(coalesce(-best[1], 0), 6) as dice, coalesce(k, 0)::bigint as n_licenses from p left join h using (r)"""


_CHAT_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(15 + length(regexp_replace(role || text, '([\\<>#])', '\\\1', 'g')))::bigint as formatted_chars
from c group by conv_id"""

_WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha1(b) as h from p),
f as (select h, min(page_id) as m from q group by h),
d as (select page_id, n, h, case when page_id is distinct from m then m end as refers_to from q join f using (h))
select page_id, n::bigint as payload_bytes, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(5), lambda j:
    (('0x' || substr(h, 1 + (i * 5 + j) // 4, 1))::int >> (3 - (i * 5 + j) % 4)) % 2), lambda x, y: 2 * x + y)::int, 1)), '') as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from d"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _license_sql(), "op4_chat_format": _CHAT_SQL, "op8_warc": _WARC_SQL}
