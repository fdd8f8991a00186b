"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    filter_audit, fingerprints, langid, licenses, mixing, packing, quality, sharding, simhash, topk, toxicity, turn_repair, url_rules,
)
from .common import read_table, split_hash

#: Rules of the url query: verdict, host, path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), tokenizer_path(), with_ids=False, memory=128 << 20)


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(read_table(spark, folder, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op3_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = langid.fit(docs.where(split_hash("doc_id") % 4 != 2))
    return langid.identify(docs, model).withColumn("held_out", split_hash("doc_id") % 4 == 2)


def op4_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(read_table(spark, folder, "documents"))


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(f"select * from values {_RULE_ROWS} as rules(verdict, host, path)")
    return url_rules.judge(read_table(spark, folder, "pages"), rules)


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = quality.fit(docs, read_table(spark, folder, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", (split_hash("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    rows = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", rows.alias("row")
    ).drop("row")


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = toxicity.fit(docs, read_table(spark, folder, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", (split_hash("doc_id") % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    damaged = turn_repair.damage(read_table(spark, folder, "conversations"))
    return turn_repair.report(turn_repair.repair(damaged))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_topk, op3_langid, op4_order_minhash, op5_url_rules, op6_simhash, op7_quality, op8_mixing,
        op9_licenses, op10_toxicity, op11_sharding, op12_filter_audit, op13_turn_repair, pipeline,
    )
}


ORACLE = {
    "op2_topk": """
        with v as (
            select vec_id, min([cast(floor(64 * cast(x as double)) as bigint) for x in embedding]) as v
            from embeddings
            where vec_id is not null and embedding is not null
                and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
            group by vec_id
        ), s as (
            select q.vec_id as query_id, r.vec_id as vec_id,
                cast(list_inner_product(cast(q.v as double[]), cast(r.v as double[])) as bigint) as score
            from v q join v r on q.vec_id <> r.vec_id
            where q.vec_id % 20 = 0
        ), t as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
            from s
        )
        select query_id, rank, vec_id, score from t where rank <= 20
    """,
    "op5_url_rules": f"""
        with r(verdict, host, path) as (values {_RULE_ROWS}),
        rest as (
            select page_id, row_number() over () as row,
                case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
            from pages
        ), p as (
            select page_id, row, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from rest
        ), m as (
            select p.row, r.host || r.path as rule, r.verdict,
                row_number() over (partition by p.row order by length(r.host) + length(r.path) desc, length(r.host) desc) as n
            from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
        )
        select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') as verdict
        from p left join m on m.row = p.row and m.n = 1
    """,
    "op11_sharding": """
        with recursive bits(i, k, v) as (
            select range, 0, range from range(256)
            union all
            select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8
        ), tab as (
            select list(v order by i) as t from bits where k = 8
        ), d as (
            select doc_id, row_number() over () as row, sha256(coalesce(text, '')) as h, octet_length(encode(coalesce(text, ''))) + 1 as size
            from documents
        ), x as (
            select distinct sha256(coalesce(text, '')) as h, hex(encode(coalesce(text, ''))) as x from documents
        ), crc as (
            select h, xor(
                list_reduce(
                    list_transform(range(1, length(x), 2), lambda i: cast('0x' || substr(x, i, 2) as bigint)),
                    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), cast(4294967295 as bigint)
                ), 4294967295) as text_crc32
            from x, tab
        ), e as (
            select h, b, cast(sum(b) over (order by h) as bigint) as e from (select h, sum(size) as b from d group by h)
        ), a as (
            select list(e order by e) as ends, max(e) as total, cast(max(b) as bigint) as largest from e
        ), search(low, high, run, place) as (
            select greatest(largest, (total + 15) // 16) - 1, least(total, (total + 15) // 16 + largest), 0, cast(0 as bigint) from a
            union all
            select case when run = 16 and place < total then (low + high) // 2 else low end,
                case when run = 16 and place = total then (low + high) // 2 else high end,
                case when run = 16 then 0 else run + 1 end,
                case when run = 16 then 0 else list_max(list_filter(list_concat([0], ends), lambda v: v <= place + (low + high) // 2)) end
            from search, a where high - low > 1
        ), capacity as (
            select min(high) as c from search
        ), early(k, e) as (
            select 16, total from a
            union all
            select k - 1, case when e <= c then 0 else list_min(list_filter(ends, lambda v: v >= e - c)) end from early, a, capacity where k > 1
        ), walk(k, place) as (
            select 0, cast(0 as bigint)
            union all
            select k + 1, (
                select greatest(early.e, least(
                    list_max(list_filter(list_concat([0], ends), lambda v: v <= place + c)),
                    case when coalesce(after - share < share - here or here <= place, false) and after is not null then after else here end))
                from (
                    select place, share, list_max(list_filter(list_concat([0], ends), lambda v: v <= share)) as here,
                        list_min(list_filter(ends, lambda v: v > share)) as after
                    from (select place, place + (total - place) // (16 - k) as share)
                ), early where early.k = walk.k + 1
            )
            from walk, a, capacity where k < 15
        ), g as (
            select h, cast((select count(*) from walk where k > 0 and place < e.e) as integer) as shard from e
        )
        select doc_id, size, text_crc32, 'bytes' as law, shard,
            row_number() over (partition by shard order by h, doc_id nulls first) - 1 as slot, cast(null as integer) as grown_shard
        from d join g using (h) join crc using (h)
    """,
    "op12_filter_audit": """
        with w as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
            from documents
        ), m as (
            select doc_id, part,
                cast(len(words) < 200 as integer) + 2 * cast(100 * len(list_distinct(words)) < 50 * len(words) as integer)
                + 4 * cast(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) as integer)
                + 8 * cast(regexp_matches(text, '[#$%&*|]') as integer)
                + 16 * cast(coalesce(doc_id > min(doc_id) over (partition by text), false) as integer) as mask
            from w
        ), l as (
            select doc_id, max(cast(coalesce(quality = 1, false) as integer)) as good, max(cast(coalesce(toxic = 1, false) as integer)) as toxic
            from labels group by doc_id
        ), c as (
            select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
            from m left join l on m.doc_id = l.doc_id group by all
        ), f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), o as (
            select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
            from f a, f b, f c, f d, f e
            where len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
        ), s as (
            select filter_order, step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as bigint) as before
            from o, range(1, 6) as r(step)
        ), t as (
            select part, filter_order, cast(step as integer) as step, any_value(bit) as bit,
                cast(sum(case when mask & (before + bit) = 0 then n else 0 end) as bigint) as kept,
                cast(sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end) as bigint) as removed,
                cast(sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end) as bigint) as redundant,
                cast(sum(case when mask = bit then n else 0 end) as bigint) as unique_fails,
                cast(sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end) as bigint) as good_lost,
                cast(sum(case when mask & bit > 0 and mask & before = 0 then toxic else 0 end) as bigint) as toxic_lost
            from c, s group by part, filter_order, step
        )
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            cast(sum(removed) over (partition by part, bit) as bigint) as shapley
        from t
    """,
}
