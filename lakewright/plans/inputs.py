"""The driver tables as evidence, vectors, names and graphs: the inputs of the registered queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakewright.operators import evidence
from lakewright.storage import cut, table


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as observations: supplier = model, part group = dataset, line status = task, return flag = metric."""
    li = table(spark, sf, "lineitem")
    metric = F.when(F.col("l_returnflag") == "A", "Accuracy@5").when(F.col("l_returnflag") == "R", "WER").otherwise("custom-score")
    return li.select(F.col("l_suppkey").alias("model"), (F.col("l_partkey") % 50).alias("dataset"), F.col("l_linestatus").alias("task"), metric.alias("metric"), F.col("l_extendedprice").alias("value"), F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")).alias("source"))


def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Observations with one median a (model, node, metric): written once, as bounds, counts and rows are read from it."""
    return cut(evidence.dedupe_median(observations(spark, sf)), "deduplicated")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's edges of its primary metric: (model, dataset, task, metric, weight ...)."""
    return evidence.primary_edges(evidence.weighted(deduplicated(spark, sf)))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(item, v, label): the embeddings."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"), "label")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query, q, task): the vectors whose id is divisible by 20, the stated query set."""
    some = vectors(spark, sf).where("item % 20 = 0")
    return some.select(F.col("item").alias("query"), F.col("v").alias("q"), F.col("label").alias("task"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(query, item, value): recorded results of the vectors of the query's label: a hash of the pair, in hundredths."""
    v = vectors(spark, sf)
    q = queries(spark, sf)
    pair = q.select("query", F.col("task").alias("label")).join(v.select("item", "label"), "label").where("item <> query")
    value = (F.col("query") * 7919 + F.col("item") * 104729) % 101 / 100.0
    return pair.select("query", "item", value.alias("value"))


def priors(spark: SparkSession, sf: str) -> DataFrame:
    """(task, item, prior): what is known of items by task, made for all of them and apart from any score."""
    v = vectors(spark, sf)
    prior = ((F.col("item") * 31 + F.col("task") * 7) % 5 / 10.0).alias("prior")
    tasks = v.select(F.col("label").alias("task")).distinct()
    return v.select("item").join(F.broadcast(tasks)).select("task", "item", prior).where("prior > 0")


def models(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as model records: (id, name, author, base, relation, tags, size_b ...)."""
    p = table(spark, sf, "part")
    name = F.concat(F.col("p_brand"), F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_size").cast("string"), F.lit("b"), F.element_at(F.array(*map(F.lit, ("", "-GGUF", "-q4_k_m", "-int8", "-lora"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("author"), F.lower("p_type").alias("kind"), F.col("p_size").alias("p_size"), F.col("p_retailprice").alias("price"))


PIPELINES = ("text-generation", "image-classification", None, "weird-tag", "Robotics", None, "deep-rl", None, "summarization")
TYPES = ("llama", None, "whisper", "nosuch")
LIBRARIES = (None, "peft", "diffusers", "GGUF", "transformers")
TAGS = (("lora",), ("conversational", "lang:fr"), (), ("GGUF", "en", "de-DE"), ("4bit", "multilingual"), ("tts", "zh", "arxiv:1"), ("zz", "eng"))
REPOS = ("Foo-Coder", "Bar-Chat-7B", "Llama-3-8b-q4_k_m-gguf", "deberta-v3-int8", "xx-1b", "My.SQL-model", "gte-base-8bit", "Foo-gguf-lora", "1b-q8 (old)", "a_b", "fp40-x-v2")
CARDS = ((), ("en",), ("EN-us", "fr"), ("multi",), ("de", "xx-yy"), ("klingon",))
RELATIONS = (None, "quantized", "adapter", "finetune", "merge", None)


def pick(values: tuple, place) -> Column:
    """The value at a place from 0, of a list of strings or of lists of strings."""
    kind = "array<string>" if any(isinstance(v, tuple) for v in values) else "string"
    one = lambda v: F.array(*map(F.lit, v)).cast(kind) if isinstance(v, tuple) else F.lit(v).cast(kind)
    return F.element_at(F.array(*map(one, values)), (place + 1).cast("int"))


def sql_list(values: tuple) -> str:
    """The list in SQL."""
    if not values:
        return "[]::varchar[]"
    return "[" + ", ".join(sql_list(v) if isinstance(v, tuple) else "null" if v is None else f"'{v}'" for v in values) + "]"


def sql_map(values: dict) -> str:
    """The map in SQL."""
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as model records whose fields go through all cases of the cascades, each field in a period of its own."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"),
        F.concat("p_brand", F.lit("/"), pick(REPOS, k % 11)).alias("name"),
        pick(PIPELINES, k % 9).alias("pipeline"),
        pick(TYPES, k % 4).alias("model_type"),
        pick(LIBRARIES, k % 5).alias("library"),
        pick(TAGS, k % 7).alias("tags"),
        pick(CARDS, F.floor(k / 7) % 6).alias("card"),
        pick(RELATIONS, F.floor(k / 5) % 6).alias("relation"),
        (k % 13 == 0).alias("gguf"),
        (k % 3 == 0).alias("has_base"),
        (k % 2 == 0).alias("same_author"),
        F.when(k % 4 != 1, F.col("p_size").cast("long") * 300_000_000).alias("total"),
    )


SQL = {
    "rec": f"""select p_partkey as id, p_brand || '/' || ({sql_list(REPOS)})[p_partkey % 11 + 1] as name,
 ({sql_list(PIPELINES)})[p_partkey % 9 + 1] as pipeline, ({sql_list(TYPES)})[p_partkey % 4 + 1] as model_type,
 ({sql_list(LIBRARIES)})[p_partkey % 5 + 1] as library, ({sql_list(TAGS)})[p_partkey % 7 + 1] as tags,
 ({sql_list(CARDS)})[p_partkey // 7 % 6 + 1] as card, ({sql_list(RELATIONS)})[p_partkey // 5 % 6 + 1] as relation,
 p_partkey % 13 = 0 as gguf, p_partkey % 3 = 0 as has_base, p_partkey % 2 = 0 as same_author,
 case when p_partkey % 4 <> 1 then (p_size * 300000000::bigint) end as total from part""",
    "pri": """select task, item, (item * 31 + task * 7) % 5 / 10.0::double as prior from vec,
 (select distinct label as task from vec) where (item * 31 + task * 7) % 5 > 0""",
    "obs": """select l_suppkey as model, l_partkey % 50 as dataset, l_linestatus as task, case l_returnflag when 'A' then 'Accuracy@5' when 'R' then 'WER' else 'custom-score' end as metric,
 l_extendedprice as value, 's' || (l_linenumber % 3) as source from lineitem""",
    "ded": "select model, dataset, task, metric, median(value) as value, count(*) as n_records from obs group by all",
    "w": """select *, case when metric = 'WER' then 1 - norm else norm end as weight, case metric when 'Accuracy@5' then 'higher' when 'WER' then 'lower' else 'unknown' end as direction
 from (select *, coalesce((value - min(value) over g) / nullif(max(value) over g - min(value) over g, 0), 0.5) as norm from ded window g as (partition by dataset, task, metric))""",
    "prim": """select dataset, task, metric, direction, n from (select *, row_number() over (partition by dataset, task order by direction = 'unknown', n desc, metric) as r
 from (select dataset, task, metric, direction, count(*) as n from w group by all)) where r = 1""",
    "edges": "select w.* from w join prim using (dataset, task, metric)",
    "vec": "select vec_id as item, embedding::double[] as v, label from embeddings",
    "q": "select item as query, v as q, label as task from vec where item % 20 = 0",
    "lab": "select query, item, (query * 7919 + item * 104729) % 101 / 100.0::double as value from q join vec on label = task where item <> query",
    "sc": "select query, item, round(list_dot_product(q, v), 9) as score from q, vec",
    "models": """select p_partkey as id, p_brand || '/' || replace(p_name, ' ', '-') || '-' || p_size || 'b' || (['', '-GGUF', '-q4_k_m', '-int8', '-lora'])[p_partkey % 5 + 1] as name,
 p_brand as author, lower(p_type) as kind, p_size, p_retailprice as price from part""",
}
NEEDS = {"ded": ["obs"], "w": ["ded"], "prim": ["w"], "edges": ["w", "prim"], "q": ["vec"], "lab": ["q", "vec"], "sc": ["q", "vec"], "pri": ["vec"]}


def with_ctes(*names: str) -> str:
    """A WITH clause of the named inputs and what they are made from."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as materialized ({SQL[n]})" for n in order)
