"""Names, taxonomy, lexical baselines and nested records."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lakewright.functions import metrics, text
from lakewright.operators import graph, lexical, taxonomy
from lakewright.plans import inputs
from lakewright.plans.evidence_queries import r6
from lakewright.plans.inputs import with_ctes
from lakewright.sources import records
from lakewright.storage import table
from lakewright.streaming import ingest

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


@query(with_ctes("models") + """, m as (select id, replace(replace(name, '/', ' - '), 'Brand#', (['cosine_Accuracy@', 'WER-', 'Mean.Reward', 'nauc_', ' ndcg@'])[id % 5 + 1]) as raw from models),
 n as (select id, raw, trim(regexp_replace(regexp_replace(replace(lower(trim(raw)), '@', '_at_'), '[\\s\\-./]+', '_', 'g'), '_+', '_', 'g'), '_') as name from m)
 select id, name from n""")
def metric_names(spark, sf):
    m = inputs.models(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, ("cosine_Accuracy@", "WER-", "Mean.Reward", "nauc_", " ndcg@"))), (F.col("id") % 5 + 1).cast("int"))
    return m.select("id", text.metric_name(F.replace(F.replace("name", F.lit("/"), F.lit(" - ")), F.lit("Brand#"), kind)).alias("name"))


_RAW = ["cosine_Accuracy@5", "WER", "Mean Reward", "nauc_map", "ndcg@10", "loss_std", "max_ap", "Eval-Loss", "", "foo.bar"]


@query(f"""with m as (select p_partkey as id, ([{_quoted(_RAW)}])[p_partkey % 10 + 1] as raw from part), n as (select id, raw, trim(regexp_replace(replace(lower(raw), '@', '_at_'), '[\\s\\-./]+', '_', 'g'), '_') as name from m),
 c as (select *, regexp_replace(name, '_at_\\d+$', '') as cut from n), b as (select *, coalesce(nullif(regexp_extract(cut, '^(?:{'|'.join(metrics.PREFIXES)})(.+)$', 1), ''), cut) as base from c)
 select case when name = '' or regexp_matches(name, '^naucs?_') then 'unknown' when base in ({_quoted(metrics.REWARD)}) then 'reward' when base in ({_quoted(metrics.HIGHER)}) then 'higher' when base in ({_quoted(metrics.LOWER)}) then 'lower' else 'unknown' end as direction, raw, count(*) as n from b group by all""")
def metric_directions(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, sf, "part").select(raw.alias("raw")).withColumn("direction", metrics.direction(F.col("raw"))).groupBy("direction", "raw").agg(F.count("*").alias("n"))


@query("select s_suppkey as id, ((s_suppkey::hugeint * 11400714819323198485 + 15111065706836454659) % 18446744073709551616)::varchar as tie from supplier")
def tie_keys(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), text.tie_key(F.col("s_suppkey")).cast("string").alias("tie"))


@query("select c_custkey as id, ((('0x' || substr(md5(c_name), 1, 16))::uhugeint % 10000 * 1616 + ('0x' || substr(md5(c_name), 17, 16))::uhugeint % 10000) % 10000)::bigint as bucket from customer")
def name_buckets(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.md5_bucket(F.col("c_name")).alias("bucket"))


@query(
    with_ctes("rec")
    + r""" select id, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(name), '\(.*?\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ''), lower(name)) as root,
 translate(name, '/-_', '   ') as clean, split_part(name, '/', 1) as owner,
 array_to_string(list_filter(list_filter(regexp_split_to_array(lower(name), '[/\-_.\s#]+'), lambda t: t <> ''), lambda t, i: list_position(list_filter(regexp_split_to_array(lower(name), '[/\-_.\s#]+'), lambda u: u <> ''), t) = i), ' ') as tokens,
 regexp_replace(lower(trim(coalesce(pipeline, ' A  b_c '))), '[\s_]+', '-', 'g') as task from rec"""
)
def name_forms(spark, sf):
    n = F.col("name")
    tokens = text.name_tokens(n)
    return inputs.records(spark, sf).select(
        "id",
        text.root_name(n).alias("root"),
        text.clean_name(n).alias("clean"),
        text.root_of(n).alias("owner"),
        F.array_join(F.slice(tokens, 2, F.size(tokens)), " ").alias("tokens"),
        text.task_name(F.coalesce("pipeline", F.lit(" A  b_c "))).alias("task"),
    )


@query(
    with_ctes("rec")
    + rf""", t as (select id, split_part(name, '/', 2) as repo, list_filter(regexp_split_to_array(lower(split_part(name, '/', 2)), '[-_.\s]+'),
 lambda x: x <> '' and x not in ({_quoted(taxonomy.STEM_OUT)}) and not regexp_full_match(x, '\d+(\.\d+)?[bmk]')) as k from rec)
 select id, case when len(k) = 0 then lower(repo) else array_to_string(k, '-') end as stem from t"""
)
def repo_stems(spark, sf):
    return inputs.records(spark, sf).select("id", taxonomy.repo_stem(F.col("name")).alias("stem"))


_SCALE_SQL = "case " + " ".join(f"when s < {top} then '{name}'" for top, name in taxonomy.SCALES) + " else '>=90B' end"


@query(f"with m as (select p_size * 2.3 as s, p_retailprice as p from part) select {_SCALE_SQL} as scale, least(14, greatest(1, floor((log10(p * 1e4) - 5) / 0.5) + 1))::int as bucket, count(*) as n from m group by all")
def size_buckets(spark, sf):
    return table(spark, sf, "part").select(taxonomy.scale_bucket(F.col("p_size") * 2.3).alias("scale"), taxonomy.log_bucket(F.col("p_retailprice") * 1e4).alias("bucket")).groupBy("scale", "bucket").agg(F.count("*").alias("n"))


@query("""with m as (select case when p_partkey % 3 = 0 then 't' end as tag, p_partkey % 9 = 0 as res, case when p_partkey % 4 = 0 then p_size end as size, case when p_partkey % 5 = 0 then 'b' end as base from part)
 select case when tag is null and size is null then 'dropped' when res then 'labeled' when base is not null then 'lineage' else 'plain' end as layer, case when tag is not null then 'tag' when base is not null then 'base' else 'none' end as source, count(*) as n from m group by all""")
def record_layers(spark, sf):
    k = F.col("p_partkey")
    tag, base = F.when(k % 3 == 0, "t"), F.when(k % 5 == 0, "b")
    layer = taxonomy.layer(tag, F.array().cast("array<string>"), F.when(k % 4 == 0, F.col("p_size")), k % 9 == 0, base)
    return table(spark, sf, "part").groupBy(layer.alias("layer"), taxonomy.first_known((tag, "tag"), (base, "base"))["source"].alias("source")).agg(F.count("*").alias("n"))


@query("""with a as (select p_brand as author, p_name as stem, p_size % 2 = 0 as q, p_size % 10 = 0 as o, p_type as up from part), s as (select author, stem, count(*) as k, sum(q::int) as q, sum(o::int) as o from a group by all),
 g as (select author, sum(k) as n, sum(q) as q, sum(o) as o, sum(case when k > 1 then k else 0 end) as r from s group by all), u as (select author, count(distinct up) as u from a group by all)
 select author, n::bigint as n, round(least(1, case when n >= 500 then 0.3 when n >= 100 then 0.18 when n >= 30 then 0.08 else 0 end + case when q / n >= 0.8 then 0.3 when q / n >= 0.5 then 0.18 else 0 end + case when u >= 100 then 0.2 when u >= 20 then 0.1 else 0 end
 + case when o / n <= 0.05 then 0.15 when o / n <= 0.2 then 0.07 else 0 end + case when r / n >= 0.5 then 0.05 else 0 end), 6)::double as mirror_score from g join u using (author)""")
def mirror_scores(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_brand").alias("author"), F.col("p_name").alias("stem"), (F.col("p_size") % 2 == 0).alias("is_quant"), (F.col("p_size") % 10 == 0).alias("is_original"), F.col("p_type").alias("upstream"))
    return taxonomy.mirror_score(a).select("author", "n", r6("mirror_score"))


_TAILS = ("", "-GGUF", "-q4_k_m-gguf", "-gguf-q4_k_m", "-lora-8bit-q5-fp16", "_IQ3_xs.awq", "-peft-gguf-int4-q8-lora-bf16", "-qlora-x")


def _stripped(rounds: int) -> str:
    """The marks taken off in SQL: all in turn, so many times."""
    out = "select name, head, tail as s0 from p"
    steps = [m for _ in range(rounds) for m in graph.NAME_MARKS]
    for i, mark in enumerate(steps):
        cut = f"regexp_replace(s{i}, '{mark}', '', 'i')"
        out = f"select name, head, case when length({cut}) >= 3 then {cut} else s{i} end as s{i + 1} from ({out})"
    return f"select name, head || s{len(steps)} as base from ({out})"


@query(
    f"""with n as (select distinct p_brand || '/' || p_size || 'model' || ({inputs.sql_list(_TAILS)})[p_partkey % 8 + 1] as name from part),
 p as (select name, split_part(name, '/', 1) || '/' as head, split_part(name, '/', 2) as tail from n), b as ({_stripped(4)})
 select name, base from b where base <> name and base in (select name from n)"""
)
def lineage_by_name(spark, sf):
    p = table(spark, sf, "part")
    tail = inputs.pick(_TAILS, F.col("p_partkey") % 8)
    names = p.select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("model"), tail).alias("name")).distinct()
    return graph.lineage_by_name(names)


@query("""with m as (select p_partkey as id, ' ' || upper(p_name) || p_partkey as name, lower(q_name) || q_key as base, relation from (select p_partkey, p_name, (p_partkey // 2)::bigint as q_key, (['finetune', 'adapter', 'quantized'])[p_partkey % 3 + 1] as relation from part) join (select p_partkey as k, p_name as q_name from part) on k = q_key)
 select a.id as src, b.id as dst, b.relation from m b join m a on lower(trim(a.name)) = b.base where a.id <> b.id""")
def lineage_edges(spark, sf):
    p = table(spark, sf, "part")
    parent = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("q_name"))
    rel = F.element_at(F.array(*map(F.lit, ("finetune", "adapter", "quantized"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    m = p.withColumn("k", F.floor(F.col("p_partkey") / 2)).join(parent, "k").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.upper("p_name"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lower("q_name"), F.col("k").cast("string")).alias("base"), rel.alias("relation"))
    return graph.lineage(m)


@query("""with c as (select p_partkey as id, p_name as exact, p_type as base from part), u as (select base, min(id) as id, count(*) as n from c group by all), x as (select exact, min(id) as id from c group by all),
 q as (select o_orderkey as k, case o_orderkey % 3 when 0 then (select min(exact) from c) when 1 then 'PROMO ' || o_orderkey else 'no such' end as name from orders)
 select case when x.id is not null then 'exact' when u.n = 1 then 'base' when u.n > 1 then 'ambiguous' else 'rejected' end as match, count(*) as n from q left join x on q.name = x.exact left join u on q.name = u.base group by all""")
def card_matching(spark, sf):
    """Exact id first, then a unique base name; several candidates are ambiguous."""
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("exact"), F.col("p_type").alias("base"))
    x = c.groupBy(F.col("exact").alias("name")).agg(F.min("id").alias("exact_id"))
    u = c.groupBy(F.col("base").alias("name")).agg(F.count("*").alias("k"))
    least = c.agg(F.min("exact").alias("least"))
    key = F.col("o_orderkey")
    q = table(spark, sf, "orders").select("o_orderkey").join(least).select(F.when(key % 3 == 0, F.col("least")).when(key % 3 == 1, F.concat(F.lit("PROMO "), key.cast("string"))).otherwise("no such").alias("name"))
    j = q.join(x, "name", "left").join(u, "name", "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("k") == 1, "base").when(F.col("k") > 1, "ambiguous").otherwise("rejected")
    return j.groupBy(how.alias("match")).agg(F.count("*").alias("n"))


_BM = """with qt as (select item_id as query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from benchmark),
 dt as (select doc_id as doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents),
 tf as (select doc, token, count(*) as tf from dt group by all), st as (select count(distinct doc) as n from tf),
 df as (select token, count(*) as df from tf group by all),
 idf as (select token, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from df, st where df >= 2 and df <= 0.25 * n),
 kept as (select tf.*, idf from tf join idf using (token)), dl as (select doc, sum(tf) as len from kept group by all),
 av as (select (select sum(len) from dl) / n as al from st),
 s as (select query, doc, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) as score from (select distinct * from qt)
 join kept using (token) join dl using (doc), av group by all)"""


@query(
    _BM
    + """ select query, doc, rank::int as rank, round(score, 5) as score from (select *, row_number() over (partition by query
 order by round(score, 6) desc, doc) as rank from s) where rank <= 10"""
)
def bm25_top_10(spark, sf):
    """The ten best documents for each benchmark passage."""
    q = lexical.term_counts(table(spark, sf, "benchmark").withColumnRenamed("item_id", "query"), "query", "text")
    d = lexical.term_counts(table(spark, sf, "documents").withColumnRenamed("doc_id", "doc"), "doc", "text")
    s = lexical.bm25(q.select("query", "token"), d)
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "doc"))
    return s.withColumn("rank", r).where("rank <= 10").select("query", "doc", "rank", F.round("score", 5).alias("score"))


@query(
    r"""with n as (select distinct lower(p_brand || ' (' || p_type || ')') as name from part union select distinct n_name from nation union select 'A!' union select 'a?b'),
 c as (select name, trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')) as c from n),
 t as (select name, case when length(c) < 3 then [c] else list_distinct(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) end as t from c)
 select a.name as a, b.name as b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as jaccard from t a join t b on a.name < b.name
 where len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.5"""
)
def similar_names(spark, sf):
    p, n = table(spark, sf, "part"), table(spark, sf, "nation")
    brand = F.lower(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))).alias("name")
    odd = spark.createDataFrame([("A!",), ("a?b",)], "name string")
    return lexical.trigram_similar(p.select(brand).union(n.select("n_name")).union(odd), 0.5).select("a", "b", r6("jaccard"))


@query("with p as (select *, json_extract_string(props, '$.' || json_keys(props)[1]) as first from events) select event_type, count(*) as n, count(first) as filled, count(distinct json_keys(props)[1]) as keys from p group by all")
def json_properties(spark, sf):
    keys = F.json_object_keys("props")
    e = table(spark, sf, "events").withColumn("k", F.element_at(keys, 1)).withColumn("first", F.from_json("props", "map<string,string>")[F.col("k")])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("first").alias("filled"), F.countDistinct("k").alias("keys"))


@query("""with v as (select p_partkey as id, ([' 88% ', '[0.3]', '11.05 +/- 5.90', 'n/a', '', 'true', 'NaN', '1e3', '[1, 2]', p_retailprice::varchar])[p_partkey % 10 + 1] as raw, p_retailprice from part)
 select id, case p_k when 0 then 88 when 1 then 0.3 when 7 then 1000 when 9 then p_retailprice end::double as value from (select *, id % 10 as p_k from v)""")
def tolerant_numbers(spark, sf):
    p = table(spark, sf, "part")
    raw = F.element_at(F.array(*map(F.lit, (" 88% ", "[0.3]", "11.05 +/- 5.90", "n/a", "", "true", "NaN", "1e3", "[1, 2]")), F.col("p_retailprice").cast("string")), (F.col("p_partkey") % 10 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), text.number(raw).alias("value"))


@query("""select 'm' || p_partkey as model, 'd' || p_size as dataset, 'ner' as task, 'f1' as metric, round(p_retailprice, 2) as value from part where p_size % 2 = 0""")
def model_index_claims(spark, sf):
    """Parts as nested model indexes, flattened to claims: entries without dataset or with bad values go."""
    p = table(spark, sf, "part")
    metric = F.array(F.struct(F.lit("f1").alias("type"), F.round("p_retailprice", 2).cast("string").alias("value")), F.struct(F.lit("f1").alias("type"), F.lit("n/a").alias("value")))
    entry = F.struct(F.lit("ner").alias("task"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("d"), F.col("p_size").cast("string"))).alias("dataset"), metric.alias("metrics"))
    rec = p.select(F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("id"), F.to_json(F.array(entry)).alias("index"))
    return records.claims(rec, F.col("index"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_counts(spark, sf):
    return ingest.windowed_counts(table(spark, sf, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("select user_id, min(event_id) as event_id from events group by all")
def deduplicated_events(spark, sf):
    """The first event of each user, by an explicit order."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
