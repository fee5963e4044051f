"""Registered queries: documents, retrieval, chat, payloads, guard, text functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import guard, payload, text
from ..functions.dates import file_stamp, reporting_calendar, version_tag
from ..operators import documents as docs, filters, patterns, retrieval as ret, text_index, vector_cells
from ..registry import query, table, texts
from ..sources import sinks
from .inputs import RECORDS, records, sql_strip, sql_terms, sql_with, sql_words

KEYWORD_QUERIES = {"q1": "onen reon oner", "q2": "elle eau", "q3": "here hand annd the"}
PROBES = {f"v{k}": [round(math.sin(k + i * 0.37), 4) for i in range(64)] for k in (1, 2, 3)}


def documents(spark, sf):
    return texts(spark, sf, "documents", "doc_id")


# --- chunking and merging -----------------------------------------------------------------------

def sql_chunks(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""chunks AS (SELECT doc_id, source, lang, n AS chunk_no, substr(text, (n * {step} + 1)::BIGINT, {size}) AS content FROM (
  SELECT doc_id, source, lang, text, unnest(range(0, greatest(ceil((length(text) - {size}) / {step}.0), 0)::BIGINT + 1))::INT AS n FROM documents))"""


@query("doc1_chunks", sql_with(sql_chunks(1000, 200)) + "SELECT doc_id, chunk_no, content FROM chunks")
def doc1(spark, sf):
    return docs.chunks(documents(spark, sf), "text").select("doc_id", "chunk_no", "content")


@query("doc1_page_chunks", sql_with(sql_chunks(2000, 200)) + "SELECT doc_id, chunk_no, length(content) AS n FROM chunks")
def doc1_pages(spark, sf):
    c = docs.chunks(documents(spark, sf), "text", docs.PAGE_SIZE, docs.PAGE_OVERLAP)
    return c.select("doc_id", "chunk_no", F.length("content").cast("bigint").alias("n"))


@query("doc2_merge_texts", """SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS content FROM conversations GROUP BY 1""")
def doc2(spark, sf):
    return docs.merge_texts(table(spark, sf, "conversations"), "conv_id", "turn", "text")


EXTENSIONS = (".pdf", ".csv", ".mp3", ".exe", "")


@query("doc3_validate_files", """WITH f AS (SELECT doc_id, n_chars * 10000 AS length, ['.pdf', '.csv', '.mp3', '.exe', ''][(doc_id % 5 + 1)::INT] AS ext FROM documents)
SELECT doc_id, length <= 104857600 AND ext IN ('.pdf', '.csv', '.mp3') AS is_valid,
  concat_ws(' / ', CASE WHEN length > 104857600 THEN 'File size (' || format('{:.1f}', length / 1048576.0) || 'MB) exceeds maximum allowed size (100.0MB)' END,
    CASE WHEN ext NOT IN ('.pdf', '.csv', '.mp3') THEN 'Unsupported file type: ' || ext || '. Supported types: .pdf, .txt, .doc, .docx, .md, .xlsx, .csv, .xls, .mp3, .wav, .m4a, .mp4, .avi, .mov' END) AS errors FROM f""")
def doc3(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 5 + 1).cast("int"))
    files = documents(spark, sf).select("doc_id", F.concat(F.lit("in/doc_"), F.col("doc_id").cast("string"), ext).alias("path"),
                                        (F.col("n_chars") * 10000).alias("length"))
    return docs.validate_files(files).select("doc_id", "is_valid", F.array_join("errors", " / ").alias("errors"))


@query("doc5_not_deleted", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def doc5(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_deleted"))
    return filters.not_deleted(documents(spark, sf).join(l, "doc_id", "left")).select("doc_id")


PHRASES = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents) GROUP BY 1, 2),
df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
phrases AS (SELECT doc_id, term, position, weight FROM (SELECT doc_id, term, tf * idf AS weight,
  row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * idf, 9) DESC, term) AS position FROM tf JOIN df USING (term)) WHERE position <= 3)"""


def phrases(spark, sf):
    return docs.key_phrases(documents(spark, sf), "doc_id", "text", 3)


@query("doc6_key_phrases", sql_with(PHRASES) + "SELECT doc_id, term, position, round(weight, 6) AS weight FROM phrases")
def doc6(spark, sf):
    return phrases(spark, sf).withColumn("weight", F.round("weight", 6))


@query("doc6_quantities", r"""WITH q AS (SELECT doc_id, regexp_extract_all(text, '[0-9][0-9,]*(\.[0-9]+)? ?(%|[A-Za-z]+)') AS q FROM documents)
SELECT doc_id, len(q)::BIGINT AS n, array_to_string(q, '|') AS quantities FROM q""")
def doc6_quantities(spark, sf):
    found = docs.quantities(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, "|").alias("quantities"))


@query("doc7_compact_lines", f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), chr(13)), chr(13)), lambda x: {sql_strip('x')}), lambda x: x <> ''), chr(10)) AS content FROM documents""")
def doc7(spark, sf):
    return documents(spark, sf).select("doc_id", text.compact_lines(F.translate("text", "\n", "\r")).alias("content"))


# The opening of each benchmark item is a pattern; the item is the name, the smaller number goes first.
@query("scl25_pattern_table", """WITH p AS (SELECT lower(left(text, 20)) AS pattern, item_id FROM benchmark WHERE length(text) > 0)
SELECT doc_id, coalesce((SELECT min(item_id) FROM p WHERE contains(lower(text), pattern))::VARCHAR, 'Unknown') AS item FROM documents""")
def scl25_table(spark, sf):
    rules = table(spark, sf, "benchmark").select(F.left("text", F.lit(20)).alias("pattern"), F.col("item_id").alias("priority"), F.col("item_id").cast("string").alias("name"))
    return patterns.first_match(documents(spark, sf), "text", rules, "item").select("doc_id", "item")


@query("flt16_any_element", f"SELECT doc_id FROM documents WHERE list_contains({sql_words('text')}, 'the')")
def flt16(spark, sf):
    return documents(spark, sf).filter(filters.any_element(text.word_set(F.col("text")), "the")).select("doc_id")


@query("flt11_where_metadata", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src4', 'src7')")
def flt11(spark, sf):
    return filters.where_metadata(documents(spark, sf), {"lang": "en"}, {"source": ["src1", "src4", "src7"]}).select("doc_id")


# --- retrieval ----------------------------------------------------------------------------------

def _vector_sql(k: int, where: str = "true") -> str:
    values = ", ".join(f"('{n}', {v}::DOUBLE[])" for n, v in PROBES.items())
    return f"""probes(query, probe) AS (VALUES {values}),
vector_scores AS (SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], probe) AS score FROM embeddings, probes WHERE {where}),
vector_hits AS (SELECT query, vec_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS position
  FROM vector_scores) WHERE position <= {k})"""


@query("ret1_vector_hits", sql_with(_vector_sql(20, "label IN (1, 3, 5, 7)")) + "SELECT query, vec_id, round(score, 6) AS score, position FROM vector_hits")
def ret1(spark, sf):
    e = filters.where_metadata(table(spark, sf, "embeddings"), any_of={"label": [1, 3, 5, 7]})
    return ret.vector_hits(e, "vec_id", "embedding", PROBES, 20).withColumn("score", F.round("score", 6))


def _keyword_sql(k: int) -> str:
    rows = ", ".join(f"('{n}', '{t}')" for n, q in KEYWORD_QUERIES.items() for t in ret.query_terms(q))
    return f"""asked(query, term) AS (VALUES {rows}),
doc_terms AS (SELECT doc_id, {sql_terms('text')} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM doc_terms),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM doc_terms) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
keyword_scores AS (SELECT query, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg_len))) AS score
  FROM asked JOIN counts USING (term) JOIN dfs USING (term) JOIN doc_terms USING (doc_id), corpus GROUP BY 1, 2),
keyword_hits AS (SELECT query, doc_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS position
  FROM keyword_scores) WHERE position <= {k})"""


def keyword(spark, sf, k=5):
    return ret.keyword_hits(documents(spark, sf), "doc_id", "text", KEYWORD_QUERIES, k)


@query("ret2_keyword_hits", sql_with(_keyword_sql(5)) + "SELECT query, doc_id, round(score, 6) AS score, position FROM keyword_hits")
def ret2(spark, sf):
    return keyword(spark, sf).withColumn("score", F.round("score", 6))


# Requests from a table: every benchmark item asks for the documents most like it.
INDEXED = f"""asked AS (SELECT DISTINCT item_id AS query, term FROM (SELECT item_id, unnest({sql_terms('text')}) AS term FROM benchmark)),
doc_terms AS (SELECT doc_id, {sql_terms('text')} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM doc_terms),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM doc_terms) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
indexed_scores AS (SELECT query, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg_len))) AS score
  FROM asked JOIN counts USING (term) JOIN dfs USING (term) JOIN doc_terms USING (doc_id), corpus GROUP BY 1, 2),
indexed_hits AS (SELECT query, doc_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS position FROM indexed_scores))"""


def indexed(spark, sf, k):
    path = sinks.scratch(spark, "text-index")
    text_index.write_index(documents(spark, sf), "doc_id", "text", path, 32)
    return text_index.search(spark, path, table(spark, sf, "benchmark"), k, query="item_id")


@query("ret2_indexed_hits", sql_with(INDEXED) + "SELECT query, doc_id, round(score, 6) AS score, position FROM indexed_hits WHERE position <= 5")
def ret2_indexed(spark, sf):
    return indexed(spark, sf, 5).withColumn("score", F.round("score", 6))


CELL_HITS = """cell_hits AS (SELECT query, vec_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS position
  FROM (SELECT a.item_id AS query, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
        FROM benchmark a JOIN embeddings v ON v.vec_id = a.item_id, embeddings e)))"""


def cell_hits(spark, sf, k):
    """Each benchmark item asks with the vector of its number."""
    path, e = sinks.scratch(spark, "vector-cells"), table(spark, sf, "embeddings")
    vector_cells.write_cells(e, "vec_id", "embedding", path, 32)
    asked = table(spark, sf, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query"), F.col("embedding").alias("vector"))
    return vector_cells.search(spark, path, asked, k, key="vec_id")


@query("ret1_cell_hits", sql_with(CELL_HITS) + "SELECT query, vec_id, round(score, 6) AS score, position FROM cell_hits WHERE position <= 20")
def ret1_cells(spark, sf):
    return cell_hits(spark, sf, 20).withColumn("score", F.round("score", 6))


@query("ret3_indexed_hits", sql_with(INDEXED, CELL_HITS) + """, f AS (SELECT coalesce(k.query, v.query) AS query, coalesce(k.doc_id, v.vec_id) AS doc_id,
  coalesce(1.0 / (60 + k.position), 0) + coalesce(1.0 / (60 + v.position), 0) AS score
  FROM (SELECT * FROM indexed_hits WHERE position <= 50) k FULL JOIN (SELECT * FROM cell_hits WHERE position <= 50) v ON k.query = v.query AND k.doc_id = v.vec_id)
SELECT query, doc_id, round(score, 8)::DOUBLE AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS position FROM f)
WHERE position <= 5""")
def ret3_indexed(spark, sf):
    v = cell_hits(spark, sf, 50).withColumnRenamed("vec_id", "doc_id")
    return ret.fuse(indexed(spark, sf, 50), v, "doc_id", 5).select("query", "doc_id", F.round("score", 8).alias("score"), "position")


FUSED_VECTOR = _vector_sql(50).replace("('v", "('q")


@query("ret3_hybrid_hits", sql_with(_keyword_sql(50), FUSED_VECTOR) + """, f AS (SELECT coalesce(k.query, v.query) AS query, coalesce(k.doc_id, v.vec_id) AS doc_id,
  coalesce(1.0 / (60 + k.position), 0) + coalesce(1.0 / (60 + v.position), 0) AS score
  FROM keyword_hits k FULL JOIN vector_hits v ON k.query = v.query AND k.doc_id = v.vec_id)
SELECT query, doc_id, round(score, 8)::DOUBLE AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS position FROM f)
WHERE position <= 5""")
def ret3(spark, sf):
    probes = {n.replace("v", "q"): v for n, v in PROBES.items()}
    v = ret.vector_hits(table(spark, sf, "embeddings"), "vec_id", "embedding", probes, 50).withColumnRenamed("vec_id", "doc_id")
    return ret.fuse(keyword(spark, sf, 50), v, "doc_id", 5).select("query", "doc_id", F.round("score", 8).alias("score"), "position")


def hits(spark, sf):
    """Keyword hits with the document's content, location, page and owner."""
    h = keyword(spark, sf, 5).withColumn("score", F.round("score", 6))
    d = documents(spark, sf).select(
        "doc_id", F.col("text").alias("content"), F.col("source").alias("bank"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("docs/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("location"),
        F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 30).cast("double")).alias("page"))
    return h.join(d, "doc_id")


HITS = _keyword_sql(5) + """,
hits AS (SELECT query, position, round(score, 6) AS score, text AS content, source AS bank, 'doc_' || doc_id || '.txt' AS file_name,
  CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 30)::VARCHAR ELSE 'N/A' END AS page FROM keyword_hits JOIN documents USING (doc_id))"""


@query("ret4_context_block", sql_with(HITS) + """SELECT query, string_agg('Source: ' || file_name || chr(10) || 'Page: ' || CASE page WHEN 'N/A' THEN page ELSE page || '.0' END || chr(10) || 'Content: ' || content
|| chr(10) || 'Relevance Score: ' || score || chr(10) || '---', chr(10) || chr(10) ORDER BY position) AS context FROM hits GROUP BY 1""")
def ret4(spark, sf):
    return ret.context_block(hits(spark, sf))


@query("ret5_citation_line", sql_with(HITS) + """SELECT query, '**Sources:** ' || string_agg(file_name || ' (Page ' || page || ')', ', ' ORDER BY file_name || ' (Page ' || page || ')') AS sources FROM hits GROUP BY 1""")
def ret5(spark, sf):
    return ret.citation_line(ret.citations(hits(spark, sf), ["query"]), "query")


CHUNK_REFS = sql_chunks(1000, 200)


@query("ret5_srt4_citations", sql_with(CHUNK_REFS) + """, p AS (SELECT DISTINCT 'doc_' || doc_id || '.txt' AS doc, CASE WHEN chunk_no % 9 = 8 THEN 'N/A' ELSE (chunk_no + 1)::VARCHAR END AS page FROM chunks)
SELECT doc, pages, doc || ' (Page ' || pages || ')' AS citation FROM (
  SELECT doc, string_agg(page, ', ' ORDER BY try_cast(page AS BIGINT) NULLS LAST, page) AS pages FROM p GROUP BY 1)""")
def ret5_pages(spark, sf):
    c = docs.chunks(documents(spark, sf).select("doc_id", "text"), "text")
    refs = c.select(F.concat(F.lit("docs/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("location"),
                    F.when(F.col("chunk_no") % 9 != 8, (F.col("chunk_no") + 1).cast("double")).alias("page"))
    return ret.citations(refs)


@query("ret5_citation_list", sql_with(HITS) + "SELECT DISTINCT file_name || ' (Page ' || page || ')' AS source FROM hits")
def ret5_list(spark, sf):
    return ret.citation_list(hits(spark, sf))


@query("ret6_facet_counts", sql_with(PHRASES) + f""", h AS (SELECT doc_id, lang, source FROM documents WHERE list_contains({sql_terms('text')}, 'the'))
SELECT 'lang' AS facet, lang AS value, count(*) AS hits FROM h GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM h GROUP BY 2
UNION ALL SELECT 'phrases', term, count(*) FROM phrases WHERE doc_id IN (SELECT doc_id FROM h) GROUP BY 2""")
def ret6(spark, sf):
    h = documents(spark, sf).filter(F.array_contains(text.terms(F.col("text")), "the")).select("doc_id", "lang", "source")
    p = phrases(spark, sf).groupBy("doc_id").agg(F.collect_list("term").alias("phrases"))
    return ret.facet_counts(h.join(p, "doc_id", "left"), ["lang", "source", "phrases"])


@query("ret7_answer_context", sql_with(HITS) + """SELECT query, string_agg('Source ' || position || ' (' || bank || ' - ' || file_name || '):' || chr(10) || content[1:1000], chr(10) || chr(10) ORDER BY position) AS context
FROM hits WHERE position <= 3 GROUP BY 1""")
def ret7(spark, sf):
    return ret.answer_context(hits(spark, sf))


@query("ret7_summary", sql_with(HITS) + """SELECT query, string_agg('From ' || bank || ': ' || content[1:200] || '...', chr(10) || chr(10) ORDER BY position) AS summary
FROM hits WHERE position <= 2 GROUP BY 1""")
def ret7_summary(spark, sf):
    return ret.answer_summary(hits(spark, sf))


@query("win7_chat_context", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM r WHERE back <= 10 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, string_agg('Previous Question: ' || text || chr(10) || chr(10) || 'Previous Answer: ' || next_text, chr(10) || chr(10) ORDER BY turn) AS context FROM k
  WHERE i % 2 = 0 AND role = 'user' AND next_role = 'assistant' GROUP BY 1)
SELECT conv_id, coalesce(context, '') AS context FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN p USING (conv_id)""")
def win7(spark, sf):
    return ret.chat_context(table(spark, sf, "conversations"))


@query("win7_chat_context_json", f"""WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND turn % 4 = 1
  THEN 'Previous Answer: ' || translate(text, '#', ' ') || chr(10) || chr(10) || 'Previous Charts: Chart 1: 2 columns, 1 rows'
  WHEN role = 'assistant' THEN 'Previous Answer: ' || {sql_strip("translate(text, '#{}', '')")} ELSE text END AS line FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, lead(role) OVER w AS next_role, lead(line) OVER w AS next_line FROM r WHERE back <= 10 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, string_agg('Previous Question: ' || text || chr(10) || chr(10) || next_line, chr(10) || chr(10) ORDER BY turn) AS context FROM k
  WHERE i % 2 = 0 AND role = 'user' AND next_role = 'assistant' GROUP BY 1)
SELECT conv_id, coalesce(context, '') AS context FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN p USING (conv_id)""")
def win7_json(spark, sf):
    """Every other answer comes as a JSON payload with a chart."""
    c = table(spark, sf, "conversations")
    payload_of = F.to_json(F.struct(F.translate("text", "#", " ").alias("answer"), F.array(F.struct(
        F.array(F.lit("name"), F.lit("value")).alias("header"), F.array(F.array(F.lit("x"), F.lit("1"))).alias("rows"))).alias("chart_data")))
    said = F.when(F.col("turn") % 4 == 1, payload_of).otherwise(F.translate("text", "#{}", ""))
    return ret.chat_context(c.withColumn("text", F.when(F.col("role") == "assistant", said).otherwise(F.col("text"))), reply=ret.json_reply)


# --- payloads -----------------------------------------------------------------------------------

def supplier_rows(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_extendedprice").alias("total"))


def replies(spark, sf):
    """Model-like replies: one chart of money texts per supplier with broken rows; every third one needs
    repair, every seventh has no JSON at all. A supplier has at most one row per return flag."""
    row = lambda *cells: F.concat(F.lit("["), F.concat_ws(", ", *cells), F.lit("]"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    good = row(quoted(F.col("l_returnflag")), quoted(F.concat(F.lit("£"), F.format_number("total", 2))))
    lines = supplier_rows(spark, sf).groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(good)), ", ").alias("rows"))
    broken = F.lit(', ["short"], ["bad", "n/a"]')
    body = F.concat(F.lit('{"answer": "Totals of '), F.col("l_suppkey").cast("string"), F.lit('", "chart_data": [{"header": ["Flag", "Total"], "rows": ['),
                    F.col("rows"), broken, F.when(F.col("l_suppkey") % 3 == 0, ",").otherwise(""),
                    F.lit(']}, {"header": ["One"], "rows": [["x"]]}], "chart_type": "bar"'),
                    F.when(F.col("l_suppkey") % 3 == 0, ", # choose a type\n").otherwise(""), F.lit("}"))
    return lines.select("l_suppkey", F.when(F.col("l_suppkey") % 7 == 0, " No figures found. ").otherwise(
        F.concat(F.lit("Here you are: "), body, F.lit(" Regards"))).alias("reply"))


@query("scl16_parse_payload", """SELECT l_suppkey, CASE WHEN l_suppkey % 7 = 0 THEN 'No figures found.' ELSE 'Totals of ' || l_suppkey END AS answer,
CASE WHEN l_suppkey % 7 <> 0 THEN 'bar' END AS chart_type, CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE 2 END AS charts FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def scl16(spark, sf):
    p = replies(spark, sf).withColumn("p", payload.parse_payload(F.col("reply")))
    return p.select("l_suppkey", "p.answer", "p.chart_type", F.size("p.chart_data").alias("charts"))


@query("scl17_clean_charts", """SELECT l_suppkey, l_returnflag AS flag, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2""")
def scl17(spark, sf):
    p = replies(spark, sf).withColumn("c", payload.clean_charts(payload.parse_payload(F.col("reply"))["chart_data"]))
    rows = p.select("l_suppkey", F.explode("c").alias("chart")).select("l_suppkey", F.explode("chart.rows").alias("r"))
    return rows.select("l_suppkey", F.get("r", F.lit(0)).alias("flag"), F.get("r", F.lit(1)).cast("double").alias("total"))


@query("scl18_clean_charts_typed", """SELECT l_suppkey, l_returnflag AS flag, format('{:.2f}', sum(l_extendedprice)) AS total FROM lineitem GROUP BY 1, 2
UNION ALL SELECT DISTINCT l_suppkey, 'open', NULL FROM lineitem UNION ALL SELECT DISTINCT l_suppkey, 'unknown', 'n/a' FROM lineitem""")
def scl18(spark, sf):
    pairs = supplier_rows(spark, sf).groupBy("l_suppkey").agg(F.array_sort(F.collect_list(
        F.array(F.col("l_returnflag"), F.replace(F.format_number("total", 2), F.lit(","))))).alias("rows"))
    extra = F.array(F.array(F.lit("open"), F.lit(None).cast("string")), F.array(F.lit("unknown"), F.lit("n/a")), F.array(F.lit("short")))
    charts = F.array(F.struct(F.array(F.lit("Flag"), F.lit("Total")).alias("header"), F.concat("rows", extra).alias("rows")))
    done = pairs.select("l_suppkey", F.explode(payload.clean_charts_typed(charts)).alias("c")).select("l_suppkey", F.explode("c.rows").alias("r"))
    return done.select("l_suppkey", F.get("r", F.lit(0)).alias("flag"), F.get("r", F.lit(1)).alias("total"))


# --- guard --------------------------------------------------------------------------------------

def _sql_text(s: str) -> str:
    return s.replace("'", "''")


def _sql_replaced(expression: str, entity: str) -> str:
    for pattern, put in guard.steps(entity):
        expression = f"regexp_replace({expression}, '{_sql_text(pattern)}', '{put}', 'g')"
    return expression


def _sql_count(entity: str) -> str:
    label = rf"\[{entity}\]"
    return f"(len(regexp_extract_all({_sql_replaced('text', entity)}, '{label}')) - len(regexp_extract_all(text, '{label}')))::BIGINT"


REDACTED = "text"
for _name in guard.PII_PATTERNS:
    REDACTED = _sql_replaced(REDACTED, _name)
PROMPTS = """prompts AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Please DROP the table. ' WHEN 1 THEN 'What is the Private Key? ' WHEN 2 THEN 'dropped hackers ' ELSE '' END || text AS prompt FROM documents)"""


def prompts(spark, sf):
    k = F.col("doc_id") % 6
    lead = F.when(k == 0, "Please DROP the table. ").when(k == 1, "What is the Private Key? ").when(k == 2, "dropped hackers ").otherwise("")
    return documents(spark, sf).select("doc_id", F.concat(lead, F.col("text")).alias("prompt"))


@query("scl22_pii_counts", "SELECT doc_id, " + ", ".join(
    f'{_sql_count(n)} AS "{n}"' for n in guard.PII_PATTERNS) + " FROM documents")
def scl22(spark, sf):
    return documents(spark, sf).select("doc_id", *[c.alias(n) for n, c in guard.pii_counts(F.col("text")).items()])


@query("scl22_redacted", f"SELECT doc_id, {REDACTED} AS text FROM documents")
def scl22_redact(spark, sf):
    return documents(spark, sf).select("doc_id", guard.redact(F.col("text")).alias("text"))


@query("scl23_guard", sql_with(PROMPTS) + f""", r AS (SELECT doc_id, CASE WHEN length(prompt) > 4096 THEN 'too_long' WHEN regexp_matches(prompt, '{_sql_text(guard.KEYWORD_PATTERN)}') THEN 'blocked_keyword'
  WHEN regexp_matches(prompt, '{_sql_text(guard.COMMAND_PATTERN)}') THEN 'sensitive_command' END AS reason FROM prompts)
SELECT doc_id, reason IS NULL AS is_valid, reason FROM r""")
def scl23(spark, sf):
    return prompts(spark, sf).select("doc_id", *[c.alias(n) for n, c in guard.guard(F.col("prompt")).items()])


@query("scl24_interactions", sql_with(RECORDS) + f"""SELECT conv_id, turn, 'successful_interaction' AS event, length({REDACTED.replace('regexp_replace(text,', 'regexp_replace(question,')}) AS prompt_length,
length({REDACTED.replace('regexp_replace(text,', 'regexp_replace(answer,')}) AS response_length,
{REDACTED.replace('regexp_replace(text,', 'regexp_replace(question,')} <> question OR {REDACTED.replace('regexp_replace(text,', 'regexp_replace(answer,')} <> answer AS pii_redacted FROM records""")
def scl24(spark, sf):
    r = records(spark, sf)
    rec = guard.interaction_record(F.lit("doc"), F.col("question"), F.col("answer"))
    return r.select("conv_id", "turn", rec.alias("r")).select("conv_id", "turn", "r.event", "r.prompt_length", "r.response_length", "r.pii_redacted")


# --- text functions -----------------------------------------------------------------------------

@query("scl10_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def scl10(spark, sf):
    return documents(spark, sf).select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("scl10_numbered_text", """SELECT doc_id, source || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '. ' || x), chr(10)) || chr(10) AS content FROM documents""")
def scl10_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.numbered_text(F.col("source"), F.split("text", "\n")).alias("content"))


@query("scl11_prefix", "SELECT p_partkey, p_name[1:2] AS prefix FROM part")
def scl11(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.prefix(F.col("p_name"), 2).alias("prefix"))


@query("scl15_clean_reply", rf"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, '\', ''), chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> ''), chr(10)) AS text FROM documents""")
def scl15(spark, sf):
    escaped = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    return documents(spark, sf).select("doc_id", text.clean_reply(escaped).alias("text"))


@query("scl20_version_tags", "SELECT o_orderkey, '1.0.' || epoch(o_orderdate)::BIGINT AS version, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders")
def scl20(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", version_tag(F.col("o_orderdate")).alias("version"), file_stamp(F.col("o_orderdate")).alias("stamp"))


BANK_FILES = ("JPMorgan_q1.pdf", "report bank of america.pdf", "wells.pdf", "Citi-2024.pdf", "Goldman.pdf", "morgan stanley.pdf", "other.pdf")


@query("scl25_canonical_name", """SELECT o_orderkey, ['JP Morgan Chase', 'Bank of America', 'Wells Fargo', 'Citigroup', 'Goldman Sachs', 'Morgan Stanley', 'Unknown'][(o_orderkey % 7 + 1)::INT] AS bank FROM orders""")
def scl25(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in BANK_FILES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", text.canonical_name(name).alias("bank"))


@query("scl26_fill_template", sql_with(RECORDS) + "SELECT conv_id, turn, 'Q: ' || question || ' C: ' || context AS prompt FROM records")
def scl26(spark, sf):
    return records(spark, sf).select("conv_id", "turn", text.fill_template(
        "Q: $user_query$ C: $context$", {"user_query": F.col("question"), "context": F.col("context")}).alias("prompt"))


def _calendar_sql() -> str:
    yy = lambda y: f"lpad((({y}) % 100)::VARCHAR, 2, '0')"
    no = lambda b: f"'Q' || ((i - {b}) % 4 + 1)"
    yr = lambda b: f"(i - {b}) // 4"
    name = lambda b: f"{no(b)} || {yy(yr(b))}"
    qd = lambda y, q: f"datediff('day', make_date(({y})::INT, {3 * q - 2}, 1), (make_date(({y})::INT, {3 * q - 2}, 1) + INTERVAL 3 MONTH)::DATE)"
    yd = lambda y: f"datediff('day', make_date(({y})::INT, 1, 1), make_date(({y} + 1)::INT, 1, 1))"
    hd = lambda y: f"CASE WHEN h = 1 THEN {qd(y, 1)} + {qd(y, 2)} ELSE {qd(y, 3)} + {qd(y, 4)} END"
    cols = {
        "half_year_period": f"'H' || h || {yy('hy')}", "prior_half_year_period": f"'H' || h || {yy('hy - 1')}",
        "prior_year_end_period": f"'FY' || {yy('y - 1')}", "current_quarter_end_period": name(1),
        "prior_quarter_end_period": name(2), "prior_quarter_end_period_previous_year": name(6),
        "total_days": yd("y"), "half_year_period_days": hd("hy"), **{f"q{n}_days": qd("y", n) for n in range(1, 5)},
        "previous_year_total_days": yd("y - 1"), "previous_year_half_year_period_days": hd("hy - 1"),
        **{f"q{n}_days_previous_year": qd("y - 1", n) for n in range(1, 5)},
        "half_year_end_results_period": "'H' || h", "quarter_end_results_period": no(1),
        "quarter_end_results_period_year": f"({yr(1)})::VARCHAR", "prior_quarter_end_results_period": no(2),
        "prior_quarter_end_results_period_year": f"({yr(2)})::VARCHAR", **{f"prior_{n}_quarter": name(2 + n) for n in range(1, 7)},
    }
    return """WITH p AS (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders),
c AS (SELECT y, q, y * 4 + q - 1 AS i, CASE WHEN q >= 3 THEN 1 ELSE 2 END AS h, CASE WHEN q >= 3 THEN y ELSE y - 1 END AS hy FROM p)
SELECT y::BIGINT AS year, q::BIGINT AS quarter, """ + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM c"


@query("scl19_reporting_calendar", _calendar_sql())
def scl19(spark, sf):
    periods = table(spark, sf, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"),
                                                F.quarter("o_orderdate").cast("bigint").alias("quarter")).distinct()
    return periods.select("year", "quarter", *[c.alias(n) for n, c in reporting_calendar(F.col("year"), F.col("quarter")).items()])
