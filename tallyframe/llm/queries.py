"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import align, chat, decontam, knn, lines, mixing, phrases, quality, secrets, sharding, simhash, suffix, warc
from tallyframe.llm._common import shared_dir, table


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents"))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.page_captures(table(spark, sf_dir, "pages")))
    field = lambda k: F.try_element_at("headers", F.lit(k))
    return found.select("record_id", "url_key", "original_id", "state", field("content-type").alias("content_type"), field("date").alias("date"), field("vary").alias("vary"), field("cache-control").alias("cache_control"))


def op9_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tallyframe/shards-{uuid.uuid4().hex}")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat.read_back(chat.format_chats(rows.unionAll(forged))).withColumnRenamed("conv", "conv_id")


def op12_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_decontaminate": op2_decontaminate,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_forest": op5_secret_forest,
    "op6_simhash_gray": op6_simhash_gray,
    "op7_quality_ftrl": op7_quality_ftrl,
    "op8_warc_revisit": op8_warc_revisit,
    "op9_shard_compaction": op9_shard_compaction,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_phrase_graph": op12_phrase_graph,
    "op13_token_align": op13_token_align,
}

ORACLE_SQL: dict[str, str] = {
    "op1_voronoi_knn": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
                   where embedding is not null and list_count(embedding) = len(embedding)
                     and list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
             s as (select q.vec_id query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint score
                   from v q join v d on q.vec_id % 100 = 0 and q.vec_id <> d.vec_id),
             r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
        select query_id, "rank", vec_id, score from r where "rank" <= 10""",
    "op3_pareto_mix": r"""
        with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size,
                          (('0x' || md5('mix|' || coalesce(doc_id::varchar, ''))[1:12])::bigint + 0.5) / 281474976710656.0 u from documents),
             s as (select source, sum(size)::bigint source_size, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double w from d group by source),
             l as (select *, 2.0 * source_size lim, sum(source_size) over () * 1.5::double total, sum(w) over () all_w,
                          coalesce(sum(2.0 * source_size) over o, 0) full_, coalesce(sum(w) over o, 0) gone
                   from s window o as (order by 2.0 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
             v as (select *, max(case when (total - full_) / (all_w - gone) * w <= lim then (total - full_) / (all_w - gone) end) over () lev from l),
             t as (select source, source_size, case when lev is null then lim else least(lim, lev * w) end::double target from v),
             r as (select d.*, source_size, target, least(2.0, case when source_size > 0 then target / source_size else 0 end) e
                   from d join t on d.source is not distinct from t.source),
             k as (select *, floor(e + 1e-12)::int whole, u / (1 - u) rnk, sum(floor(e + 1e-12)::int * size) over (partition by source) sure from r),
             c as (select *, sum(size) over (partition by source order by rnk, doc_id, size rows between unbounded preceding and current row) upto from k)
        select doc_id, size::bigint size, source_size, target,
               ((whole + (whole < 2 and upto - size / 2.0 <= target - sure)::int) * size)::bigint taken from c""",
    "op8_warc_revisit": r"""
        with c as (select page_id i, url, '"' || md5(coalesce(html, ''))[1:16] || '"' tag, strftime(make_timestamp((page_id - page_id % 50) * 1000000), '%Y-%m-%d %H:%M:%S') stamp, page_id + 500 + page_id % 200 later from pages),
             r as (select i * 2 record_id, url, i ts, case when i % 13 = 0 then 503 else 200 end status, false back, case when i % 7 <> 0 then tag end etag, case when i % 11 <> 0 then stamp end modified from c
                   union all select i * 2 + 1, url || case when contains(url, '#') then 'x' else '#again' end, later, 304, true, case when i % 5 = 0 then '"changed"' when i % 3 <> 0 then 'W/' || tag end, case when i % 4 <> 0 then stamp end from c),
             p as (select *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)?$', ''), '^www\.', '') host,
                          regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') path,
                          list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) params from r),
             k as (select *, case when host <> '' then host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end url_key from p),
             j as (select a.record_id, a.url_key, a.ts, regexp_replace(a.etag, '^W/', '') etag, a.modified, arg_max({'id': b.record_id, 'etag': regexp_replace(b.etag, '^W/', ''), 'modified': b.modified}, (b.ts, b.record_id)) o
                   from k a left join k b on not b.back and b.status = 200 and a.url_key = b.url_key and b.ts < a.ts where a.back group by all),
             s as (select *, case when o.id is null then 'no original' when etag is not null and o.etag is not null then case when etag = o.etag then 'resolved' else 'mismatch' end
                                  when modified is not null and o.modified is not null then case when modified = o.modified then 'resolved' else 'mismatch' end else 'unchecked' end state from j)
        select record_id, url_key, o.id original_id, state, case when state in ('resolved', 'unchecked') then 'text/html' end content_type, case when state in ('resolved', 'unchecked') then strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') end date,
               case when state in ('resolved', 'unchecked') then 'Accept' end vary, case when state in ('resolved', 'unchecked') then 'max-age=60' end cache_control from s""",
    "op11_chat_format": r"""
        with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
                   union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
             k as (select *, '\[\\*/?(?:INST|ROLE)\]|\[\\*TEXT\]|<\\*/?s>|<\\*</?SYS>>' pat from c)
        select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
               coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
               sum(length(t) + len(regexp_extract_all(t, pat)) + case r when 'user' then 15 when 'assistant' then 7 when 'system' then 18 else 19 + length(r) + len(regexp_extract_all(r, pat)) end)::bigint formatted_chars
        from k group by conv_id""",
    "op12_phrase_graph": r"""
        with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
             w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p where regexp_matches(piece, '[^\x20\x09]')),
             g as (select lang, unnest(flatten([[w[i:i + k - 1] for i in range(1, len(w) - k + 2)] for k in range(1, 5)])) g from w),
             f as (select lang, g, count(*) n from g group by all having count(*) >= 30),
             t as (select lang, sum(len(w))::bigint n from w group by lang),
             c as (select f.lang, f.g, f.n a, k, x.n l, y.n r, (2000000::hugeint * f.n) // (x.n + y.n) score
                   from (select *, unnest(range(1, len(g))) k from f) f join f x on x.lang = f.lang and x.g = f.g[:k] join f y on y.lang = f.lang and y.g = f.g[k + 1:]),
             b as (select * from c qualify row_number() over (partition by lang, g order by score, k) = 1),
             s as (select lang, g, max(n) cover from (select lang, n, unnest([g[:len(g) - 1], g[2:]]) g from f where len(g) > 2) group by all),
             o as (select b.*, array_to_string(b.g, ' ') phrase from b left join s using (lang, g) where cover is null or 100 * cover < 80 * a),
             k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) "rank" from o)
        select k.lang, "rank", phrase, a, l, r, t.n, score::bigint score from k join t using (lang) where "rank" <= 2000""",
}
