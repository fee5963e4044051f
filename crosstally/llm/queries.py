"""Registered queries of the training-data operators, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..registry import table
from ..sources.sinks import materialise, scratch
from . import bpe, chat, decontam, langid, lm, prefix_trie, quality, runs, sharding, simhash, topk, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), [1.0] * 40)


@query("op4_url_filter", r"""
    WITH parsed AS (
        SELECT page_id,
               coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    judged AS (
        SELECT *, CASE
            WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
        FROM parsed)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
    FROM judged""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
             url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/")]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query("op2_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE strlen(body) >= 100 GROUP BY payload_digest)
    SELECT p.page_id, strlen(p.body)::BIGINT AS payload_bytes, p.payload_digest,
           CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path, payloads=False)
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.page_of(F.col("refers_to_id")).alias("refers_to"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op10_benchmark_decontamination", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    iw AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
    dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
           FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d), (SELECT DISTINCT n FROM iw) WHERE s + n - 1 <= len(w)),
    hits AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, win)),
    hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
    hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op7_topk_search", """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
          FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# The template escapes backslashes, each '#' that two more follow, and '<' before '/turn>'.
@query("op6_chat_formatting", r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    m AS (SELECT *, 14 + length(role) + length(text)
                 + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
                 + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS chars FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM m GROUP BY conv_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    # Written, because messages get their ids as they are read.
    log = materialise(chat.events_of(conversations), "log")
    formatted = materialise(chat.format_log(chat.with_detours(log)), "formatted")
    return chat.read_back(formatted)


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_digests(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=~langid.held_out("key"))
    scored = quality.predict(docs, model).withColumn("held_out", langid.held_out())
    return scored.select("doc_id", "held_out", "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("keep"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where every tenth text (by crc32 of the id) repeats some of its words to its end."""
    words, h = F.array_remove(F.split("text", r"[ \t-\r]+"), ""), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.filter(h % 10 == 0).select("doc_id", words.alias("w"), F.size(words).alias("n"), F.floor(h / 10).alias("g"))
    planted = planted.filter("n > 0").withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    planted = planted.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    changed = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    as_they_are = docs.filter((h % 10 != 0) | h.isNull() | F.col("text").isNull() | (F.size(words) == 0))
    return planted.select("doc_id", changed.alias("text")).union(as_they_are.select("doc_id", "text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # Greatest exponent by cross multiplication; runs come by start, then period, so the first of equal ones stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda m, r: F.when(r.length * m.period > m.length * r.period, r).otherwise(m))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_prefix_trie", r"""
    WITH t AS (SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, count(*) AS n, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
              lambda x, y: list_reduce([xor(x, y)] || range(8)::UBIGINT[], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)::BIGINT % 9 AS h FROM t GROUP BY conv_id),
    b AS (SELECT c.conv_id, c.h, c.conv_id - c.conv_id % 5 AS base, coalesce(least(c.h, o.n), 0) AS m FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 5),
    r AS (SELECT b.conv_id, t.k AS d, t.text, t.id FROM b JOIN t ON t.conv_id = b.base WHERE t.k <= b.h
          UNION ALL SELECT b.conv_id, b.m + t.k - b.h, t.text, t.id FROM b JOIN t USING (conv_id) WHERE t.k > b.h),
    p AS (SELECT conv_id, d, text, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM r
          UNION ALL SELECT conv_id, 0, '', '' FROM b),
    n AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(strlen(text)) AS bytes FROM p GROUP BY path, d),
    kids AS (SELECT path[:64 * (depth - 1)] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
    full_n AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
    below AS (SELECT a.path, sum((x.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.bytes)::BIGINT AS saved_tokens
              FROM n a JOIN full_n x ON starts_with(x.path, a.path) GROUP BY a.path),
    ends AS (SELECT path, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, d) AS path FROM p GROUP BY conv_id) GROUP BY path)
    SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM full_n f JOIN below USING (path) LEFT JOIN n u ON f.depth > 0 AND u.path = f.path[:64 * (f.depth - 1)] LEFT JOIN ends ON ends.path = f.path""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialise(prefix_trie.turn_lists(table(spark, sf_dir, "conversations")), "turn-lists")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    return prefix_trie.nodes(prefix_trie.with_shared_heads(own, 5, head, 8))


@query("op13_lm_scoring")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.filter(~held_out))
    return lm.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
