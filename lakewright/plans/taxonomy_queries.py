"""Taxonomy of model records: super-tasks, languages, quantisation, origin, quality, families, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions.families import FAMILY_RULES, SKIP_TOKENS, family_by_name
from lakewright.operators import taxonomy as tx, vocabulary
from lakewright.plans import inputs
from lakewright.plans.evidence_queries import r6
from lakewright.plans.inputs import records, sql_list, sql_map, with_ctes
from lakewright.storage import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_TASK = rf""", st as (select id, {sql_map(tx.PIPELINE_TASKS)}[lower(trim(pipeline))] as p, {sql_map(tx.MODEL_TYPE_TASKS)}[model_type] as m,
 {sql_map(tx.LIBRARY_TASKS)}[lower(library)] as l,
 list_filter(list_transform(tags, lambda t: {sql_map(tx.TAG_TASKS)}[lower(t)]), lambda t: t is not null)[1] as t, pipeline, name from rec),
 s0 as (select id, name, case when p is not null then p when pipeline is not null then 'other' else coalesce(m, l, t, 'unknown') end as task,
 case when p is not null then 'pipeline_tag' when pipeline is not null then 'pipeline_tag_unmapped' when m is not null then 'config.model_type'
 when l is not null then 'library_name' when t is not null then 'tags' else 'none' end as source,
 case when p is not null then 1.0 when pipeline is not null then 0.5 when m is not null then 0.85 when l is not null then 0.7
 when t is not null then 0.55 else 0.0 end::double as confidence from st),
 task as (select id, case when c then 'code' else task end as task, case when c then source || '+name_heuristic' else source end as source,
 case when c then least(confidence, 0.5) else confidence end as confidence from (select *, task = 'text-generation-chat' and
 list_has_any(regexp_split_to_array(lower(name), '[/_\-.\s]+'), {sql_list(tx.CODE_TOKENS)}) as c from s0))"""


def _task():
    return tx.supertask(F.col("name"), F.col("pipeline"), F.col("model_type"), F.col("library"), F.col("tags"))


@query(with_ctes("rec") + _TASK + " select * from task")
def supertasks(spark, sf):
    return records(spark, sf).select("id", _task().alias("t")).select("id", "t.task", "t.source", "t.confidence")


@query(with_ctes("rec") + f" select pipeline as tag, count(*) as n from rec where pipeline is not null and not list_contains({sql_list(tuple(tx.PIPELINE_TASKS))}, lower(pipeline)) group by all")
def unmapped_tags(spark, sf):
    """Pipeline tags that no rule knows: an anti join against the rules."""
    known = spark.createDataFrame([(k,) for k in tx.PIPELINE_TASKS], "k string")
    r = records(spark, sf).where("pipeline is not null")
    return r.join(F.broadcast(known), F.lower("pipeline") == F.col("k"), "left_anti").groupBy(F.col("pipeline").alias("tag")).agg(F.count("*").alias("n"))


_LANG = """, codes as (select ['en', 'fr', 'de', 'zh', 'eng'] as known),
 cl as (select id, card, list_filter(list_transform(card, lambda c: case when list_contains(known, regexp_extract(lower(c), '^([a-z]{2,3})(?:[-_][a-z]{2,4})?$', 1))
 then regexp_extract(lower(c), '^([a-z]{2,3})(?:[-_][a-z]{2,4})?$', 1) when lower(c) in ('multi', 'multilingual') then 'multilingual' end), lambda c: c is not null) as c,
 list_filter(list_transform(tags, lambda c: case when list_contains(known, regexp_extract(replace(lower(c), 'lang:', ''), '^([a-z]{2,3})(?:[-_][a-z]{2,4})?$', 1))
 then regexp_extract(replace(lower(c), 'lang:', ''), '^([a-z]{2,3})(?:[-_][a-z]{2,4})?$', 1) when lower(c) in ('multi', 'multilingual') then 'multilingual' end), lambda c: c is not null) as t
 from rec, codes), lang as (select id, list_sort(list_distinct(case when len(c) > 0 then c else t end)) as codes,
 case when len(c) > 0 then 'cardData.language' when len(t) > 0 then 'tags' else 'none' end as source from cl),
 bucket as (select id, codes, lang.source, case when len(codes) > 1 or list_contains(codes, 'multilingual') then
 case when list_has_any(codes, ['en', 'eng', 'multilingual']) then 'multilingual-with-english' else 'non-english' end
 when len(codes) = 1 then case when codes[1] in ('en', 'eng') then 'english-primary' else 'non-english' end
 when task in ('image-classification', 'detection-segmentation', 'image-generation', 'audio-classification', 'tabular-timeseries-rl') then 'language-neutral'
 else 'unknown' end as bucket from lang join task using (id))"""


def _with_language(spark, sf):
    codes = tx.language_codes(spark)
    r = records(spark, sf).withColumn("t", _task()).withColumn("l", tx.languages(F.col("card"), F.col("tags"), codes))
    return r.withColumn("bucket", tx.language_bucket(F.col("l.languages"), F.col("t.task")))


@query(with_ctes("rec") + _TASK + _LANG + " select id, array_to_string(codes, ',') as languages, source, bucket from bucket")
def language_buckets(spark, sf):
    r = _with_language(spark, sf)
    return r.select("id", F.array_join("l.languages", ",").alias("languages"), F.col("l.source").alias("source"), "bucket")


_QUANT = ", quant as (select id, case when gguf or lower(library) in ('gguf', 'llama.cpp', 'ggml') then 'gguf' when lower(library) = 'mlx' then 'mlx' "
_QUANT += " ".join(f"when list_has_any(list_transform(tags, lambda t: lower(t)), {sql_list(v)}) then '{k}'" for k, v in tx.QUANT_TAGS.items())
_QUANT += " " + " ".join(f"when regexp_matches(lower(name), '{'|'.join(v)}') then '{k}'" for k, v in tx.QUANT_TAGS.items())
_QUANT += " else 'none' end as method, case when gguf then 'gguf_block' when lower(library) in ('gguf', 'llama.cpp', 'ggml', 'mlx') then 'library_name' "
_QUANT += f"when list_has_any(list_transform(tags, lambda t: lower(t)), {sql_list(tuple(x for v in tx.QUANT_TAGS.values() for x in v))}) then 'tags' "
_QUANT += f"when regexp_matches(lower(name), '{'|'.join(x for v in tx.QUANT_TAGS.values() for x in v)}') then 'name_heuristic' else 'none' end as qsource, "
_QUANT += r"try_cast(nullif(regexp_extract(lower(name), '(?:^|[^a-z0-9])(?:q|int|w|fp)(\d{1,2})(?:[^0-9]|$)', 1), '') as int) as b from rec)"


def _quant():
    return tx.quantisation(F.col("gguf"), F.col("library"), F.col("tags"), F.col("name"))


@query(with_ctes("rec") + _QUANT + " select id, method, case when method <> 'none' and b between 1 and 32 then b end as bits, qsource as source from quant")
def quantisation(spark, sf):
    return records(spark, sf).select("id", _quant().alias("q")).select("id", "q.method", "q.bits", "q.source")


_ORIGIN = """, made as (select id, case when method <> 'none' and qsource <> 'name_heuristic' then case when same_author then 'official-quantized' else 'quantized-conversion' end
 when library = 'peft' or list_has_any(tags, ['lora', 'peft', 'adapter']) then 'adapter-lora'
 when relation in ('finetune', 'merge') then case when same_author then 'official-derivative' else 'community-finetune' end
 when relation = 'quantized' then case when same_author then 'official-quantized' else 'quantized-conversion' end
 when relation = 'adapter' then 'adapter-lora'
 when has_base then case when same_author then 'official-derivative' else 'community-finetune' end
 when method <> 'none' then case when same_author then 'official-quantized' else 'quantized-conversion' end else 'original-base' end as type,
 case when method <> 'none' and qsource <> 'name_heuristic' then 0.9 when library = 'peft' or list_has_any(tags, ['lora', 'peft', 'adapter']) then 0.85
 when relation in ('finetune', 'merge') and same_author then 0.85 when relation in ('finetune', 'merge', 'quantized', 'adapter') then 0.9
 when has_base then 0.7 when method <> 'none' then 0.4 else 0.5 end::double as confidence from rec join quant using (id))"""


def _made():
    return tx.source_type(_quant(), F.col("library"), F.col("tags"), F.col("relation"), F.col("has_base"), F.col("same_author"))


@query(with_ctes("rec") + _QUANT + _ORIGIN + " select id, type, confidence from made")
def source_types(spark, sf):
    return records(spark, sf).select("id", _made().alias("s")).select("id", "s.type", "s.confidence")


_FLAGS = "case when sure then 'task:authoritative' end, case when not sure and task <> 'unknown' then 'task:inferred' end, case when model_type is not null then 'arch' end, "
_FLAGS += "case when len(card) > 0 or relation is not null then 'card' end, case when len(card) > 0 then 'lang' end, case when has_base then 'parent' end, "
_FLAGS += "case when total is not null then 'safetensors' end, case when id % 6 = 0 then 'model-index' end, case when id % 10 = 0 then 'NEG:disabled' end, "
_FLAGS += "case when id % 17 = 0 then 'NEG:private' end, case when id % 5 = 0 then 'NEG:gated' end, case when pipeline is null and model_type is null and len(card) = 0 then 'NEG:bare' end"


@query(
    with_ctes("rec")
    + _TASK
    + f""", f as (select *, task not in ('unknown', 'other') and source = 'pipeline_tag' as sure from rec join task using (id))
 select id, round(least(1, greatest(0, case when sure then 0.25 when task <> 'unknown' then 0.12 else 0 end + case when model_type is not null then 0.2 else 0 end
 + case when len(card) > 0 or relation is not null then 0.15 else 0 end + case when len(card) > 0 then 0.1 else 0 end + case when has_base then 0.1 else 0 end
 + case when total is not null then 0.12 else 0 end + case when id % 6 = 0 then 0.08 else 0 end - case when id % 10 = 0 then 0.6 else 0 end
 - case when id % 17 = 0 then 0.6 else 0 end - case when id % 5 = 0 then 0.1 else 0 end
 - case when pipeline is null and model_type is null and len(card) = 0 then 0.25 else 0 end)), 6)::double as score, concat_ws(',', {_FLAGS}) as flags from f"""
)
def metadata_quality(spark, sf):
    i = F.col("id")
    carded = F.size("card") > 0
    has = {
        "arch": F.col("model_type").isNotNull(), "card": carded | F.col("relation").isNotNull(), "lang": carded, "parent": F.col("has_base"),
        "safetensors": F.col("total").isNotNull(), "model-index": i % 6 == 0,
    }
    bare = F.col("pipeline").isNull() & F.col("model_type").isNull() & ~carded
    q = tx.metadata_quality(F.col("t"), has, i % 10 == 0, i % 17 == 0, i % 5 == 0, bare)
    return records(spark, sf).withColumn("t", _task()).select("id", q.alias("q")).select("id", r6("q.score", "score"), F.array_join("q.flags", ",").alias("flags"))


_SCALE = "case when size_b is null then 'unknown' " + " ".join(f"when size_b < {top} then '{name}'" for top, name in tx.SCALES) + " else '>=90B' end"


@query(
    with_ctes("rec")
    + _TASK
    + _LANG
    + _QUANT
    + _ORIGIN
    + rf""", k as (select id, name, case when id % 4 = 0 then null when id % 4 = 1 then '' else 'root' || id % 3 end as root, total / 1e9 as size_b,
 list_filter(regexp_split_to_array(lower(split_part(name, '/', 2)), '[-_.\s]+'), lambda x: x <> '' and x not in ({", ".join(repr(x) for x in tx.STEM_OUT)})
 and not regexp_full_match(x, '\d+(\.\d+)?[bmk]')) as stem from rec),
 keyed as (select id, k.name, method, concat_ws('|', coalesce(nullif(root, ''), case when len(stem) = 0 then lower(split_part(k.name, '/', 2)) else array_to_string(stem, '-') end),
 task.task, {_SCALE}, bucket, method, type) as key, case when b between 1 and 32 then b end as bits
 from k join task using (id) join bucket using (id) join quant using (id) join made using (id))
 select id, key, case when method = 'none' then concat_ws('|', key, '__unq__', name) else concat_ws('|', key, method, coalesce(bits::varchar, 'None')) end as exact_key from keyed"""
)
def duplicate_keys_of_models(spark, sf):
    r = _with_language(spark, sf).withColumn("q", _quant()).withColumn("s", _made())
    root = F.when(F.col("id") % 4 == 1, F.lit("")).when(F.col("id") % 4 > 1, F.concat(F.lit("root"), (F.col("id") % 3).cast("string")))
    size = tx.size_of(F.col("total"))["size_b"]
    key = tx.duplicate_key(root, tx.repo_stem(F.col("name")), F.col("t.task"), size, F.col("bucket"), F.col("q.method"), F.col("s.type"))
    return r.withColumn("key", key).select("id", "key", tx.duplicate_key_exact(F.col("key"), F.col("q.method"), F.col("q.bits"), F.col("name")).alias("exact_key"))


@query(
    with_ctes("rec")
    + """, b as (select id, total, relation, case when has_base then [' Up/Base-' || id % 10, 'second'] else [] end as ids, case when id % 4 = 0 then ['Card/' || id % 7] when id % 4 = 1 then [' '] end as card from rec)
 select id, total / 1e9 as size_b, case when total is not null then 'safetensors' else 'none' end as size_source,
 case when len(ids) > 0 then lower(trim(ids[1])) when trim(card[1]) <> '' then lower(trim(card[1])) end as base,
 case when len(ids) > 0 then relation when trim(card[1]) <> '' then 'declared' end as relation,
 case when len(ids) > 0 then 'baseModels' when trim(card[1]) <> '' then 'cardData.base_model' else 'none' end as base_source from b"""
)
def sizes_and_bases(spark, sf):
    i = F.col("id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    ids = F.when(F.col("has_base"), F.array(text(" Up/Base-", i % 10), F.lit("second"))).otherwise(F.array().cast("array<string>"))
    card = F.when(i % 4 == 0, F.array(text("Card/", i % 7))).when(i % 4 == 1, F.array(F.lit(" ")))
    b = tx.lineage_base(ids, F.col("relation"), card, F.lit("declared"))
    r = records(spark, sf).select("id", tx.size_of(F.col("total")).alias("s"), b.alias("b"))
    return r.select("id", "s.size_b", F.col("s.source").alias("size_source"), "b.base", "b.relation", F.col("b.source").alias("base_source"))


_RULES = "case " + " ".join(f"when contains(lower(name), '{m}') then '{f}'" for m, f in FAMILY_RULES)
_RULES += rf""" else coalesce((select upper(t[1]) || substr(t, 2) from (select list_filter(regexp_split_to_array(lower(split_part(name, '/', 2)), '[-_.\s]+'),
 lambda t: length(t) > 2 and not regexp_full_match(t, '\d+\.?\d*[bmkt]') and not regexp_matches(t, '^v\d') and regexp_matches(t, '[a-z]')
 and t not in ({", ".join(repr(x) for x in SKIP_TOKENS)}))[1] as t)), 'Other') end"""


@query(
    with_ctes("rec")
    + f""", i as (select id, model_type, {_RULES} as inferred from rec),
 f as (select id, coalesce(model_type, '') as mt, lower(inferred) as inf, inferred from i)
 select id, inferred, case when mt in ('llama', 'gpt2') then mt when inf in ('llama', 'gpt2', 'deberta') then inf when mt <> '' then mt else inf end as family,
 case when mt in ('llama', 'gpt2') then 'config.model_type|core_used' when inf in ('llama', 'gpt2', 'deberta') then 'name_rule|core_used'
 when mt <> '' then 'config.model_type|new' else 'name_rule|new' end as source from f"""
)
def families(spark, sf):
    r = records(spark, sf).select("id", "model_type", family_by_name(F.col("name")).alias("inferred"))
    f = tx.family(F.col("model_type"), F.col("inferred"), ["llama", "gpt2", "deberta"])
    return r.select("id", "inferred", f.alias("f")).select("id", "inferred", "f.family", "f.source")


@query("""with p as (select p_partkey as id, ([' 7 ', 'unknown', '', '0', '-3', '1e6', 'nan', '13.5', null])[p_partkey % 9 + 1] as raw from part)
 select id, case id % 9 when 0 then 7 when 7 then 13.5 end::double as size_b from p""")
def size_texts(spark, sf):
    raw = inputs.pick((" 7 ", "unknown", "", "0", "-3", "1e6", "nan", "13.5", None), F.col("p_partkey") % 9)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.size_text(raw).alias("size_b"))


@query(
    with_ctes("rec")
    + """ select id, array_to_string(list_filter([translate(name, '/_-', '   '), array_to_string(case when pipeline is not null then [pipeline] else [] end, ' '),
 array_to_string(list_filter(tags, lambda t: not contains(t, ':')), ' '), substr(repeat(name, 40), 1, 400)], lambda p: p <> ''), ' ') as descriptor from rec"""
)
def descriptors(spark, sf):
    tasks = F.array_compact(F.array("pipeline"))
    d = tx.descriptor(F.col("name"), tasks, F.col("tags"), F.repeat("name", F.lit(40)))
    return records(spark, sf).select("id", d.alias("descriptor"))


@query(
    with_ctes("rec")
    + """, v as (select token, row_number() over (order by token) as id from (select model_type as token from rec where model_type is not null group by all having count(*) >= 5))
 select rec.id, coalesce(v.id, 0)::bigint as type_id from rec left join v on token = model_type"""
)
def category_ids(spark, sf):
    """Model types as ids of a vocabulary; 0 where there is none."""
    r = records(spark, sf)
    none = spark.createDataFrame([], "token string, id long")
    words = vocabulary.vocabulary(r.where("model_type is not null").select(F.col("model_type").alias("token")), none, 5)
    return vocabulary.category_ids(r, "model_type", words, "type_id").select("id", "type_id")


@query("select n_name as label, n_nationkey as code from nation")
def inverted_codes(spark, sf):
    return vocabulary.inverted(table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")))
