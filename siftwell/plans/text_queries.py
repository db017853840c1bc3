"""Queries of sources and of functions over single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import text as X
from ..operators import prep
from ..sources import jsonl
from . import sqltext as S
from .derive import EXAMPLES_SQL, TRAJ_SQL, examples, table, trajectories
from .registry import query, scratch

_DOC = "coalesce(text, '')"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")


@query("s01_jsonl_scan", EXAMPLES_SQL + "SELECT id, question, array_to_string(answers, '|') AS answers, data_source FROM ex")
def s01(spark, d):
    path = scratch(spark, "examples")
    jsonl.write_records(examples(spark, d).withColumn("id", F.col("id").cast("string")).drop("origin"), path)
    return jsonl.read_examples(spark, path).select(F.col("id").cast("long").alias("id"), "question", F.array_join("answers", "|").alias("answers"), "data_source")


@query("s02_trajectory_scan", TRAJ_SQL + "SELECT id, question, data_source, len(turns) AS n_turns, search_calls, valid_format FROM tj")
def s02(spark, d):
    path = scratch(spark, "records")
    t = trajectories(spark, d).withColumns({"id": F.col("id").cast("string"), "search_calls": F.col("search_calls").cast("string"), "type": F.lit("trajectory")})
    jsonl.write_records(t, path)
    return jsonl.read_records(spark, path).select(F.col("id").cast("long").alias("id"), "question", "data_source", F.size("turns").cast("long").alias("n_turns"), F.col("search_calls").cast("long").alias("search_calls"), "valid_format")


@query("s03_drop_summaries", TRAJ_SQL + "SELECT data_source, count(*) AS n FROM tj WHERE id % 4 <> 3 GROUP BY data_source")
def s03(spark, d):
    path = scratch(spark, "mixed")
    t = trajectories(spark, d).withColumns({"type": F.when(F.col("id") % 4 == 3, "summary").otherwise("trajectory"), "id": F.col("id").cast("string")})
    jsonl.write_records(t, path)
    return jsonl.read_records(spark, path).groupBy("data_source").agg(F.count("*").alias("n"))


@query("s04_first_of_files", "SELECT source AS data_source, n_chars % 50 AS id, arg_min(doc_id, (doc_id % 3) * 1000000000 + doc_id) AS line FROM documents GROUP BY ALL")
def s04(spark, d):
    return prep.first_of_files(docs(spark, d).select(F.col("source").alias("data_source"), (F.col("n_chars") % 50).alias("id"), (F.col("doc_id") % 3).alias("file_rank"), F.col("doc_id").alias("line"))).select("data_source", "id", "line")


@query("s05_parquet_projection", "SELECT doc_id, lang FROM documents WHERE n_chars > 1000")
def s05(spark, d):
    return table(spark, d, "documents").where("n_chars > 1000").select("doc_id", "lang")


@query("s07_corpus_scan", "SELECT doc_id AS id, lang AS title, source, CAST(n_chars AS VARCHAR) AS extra FROM documents WHERE text IS NOT NULL")
def s07(spark, d):
    path = scratch(spark, "corpus")
    jsonl.write_records(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), F.col("text").alias("content"), F.lit("http://x").alias("url"), "source", F.col("n_chars").cast("string").alias("extra")), path)
    return jsonl.read_corpus(spark, path).select(F.col("id").cast("long").alias("id"), "title", "source", F.col("metadata")["extra"].alias("extra"))


@query("p01_normalize_answer", f"SELECT doc_id, md5({S.norm(_DOC)}) AS norm FROM documents")
def p01(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.normalize_answer(F.col("text"))).alias("norm"))


@query("p02_extract_answer", TRAJ_SQL + f"SELECT id, {S.answer('turns[-1].text')} AS answer FROM tj WHERE turns[-1].text IS NOT NULL")
def p02(spark, d):
    last = F.try_element_at("turns", F.lit(-1))["text"]
    return trajectories(spark, d).where(last.isNotNull()).select("id", X.extract_answer(last).alias("answer"))


_CALL = "'<tool_call> <function=search> <parameter=query> ' || {q} || ' </parameter></function></tool_call>'"


@query("p03_parse_assistant", f"""
WITH t AS (SELECT doc_id, doc_id % 5 AS k, {_DOC} AS q FROM documents),
m AS (SELECT doc_id, k, q, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS tq FROM t)
SELECT doc_id, CASE WHEN k = 0 THEN CASE WHEN tq = '' OR regexp_matches(tq, '[<>]') THEN 'invalid' ELSE 'tool' END WHEN k IN (1, 3, 4) THEN 'invalid' ELSE 'answer' END AS kind,
       CASE WHEN k = 0 AND tq <> '' AND NOT regexp_matches(tq, '[<>]') THEN tq END AS query FROM m""")
def p03(spark, d):
    q = F.col("text")
    call = F.concat(F.lit("<tool_call> <function=search> <parameter=query> "), q, F.lit(" </parameter></function></tool_call>"))
    k = F.col("doc_id") % 5
    text = F.when(k == 0, F.concat(F.lit("Let me look. "), call)).when(k == 1, F.concat(call, call)).when(k == 2, F.lit("Answer: x")).when(k == 3, F.lit("<tool_call> broken")).otherwise(F.concat(call, F.lit(" and more")))
    return docs(spark, d).select("doc_id", X.parse_assistant(text).alias("p")).select("doc_id", "p.kind", "p.query")


@query("p07_normalize_query", f"SELECT doc_id, md5({S.squeeze(f'lower({_DOC})')}) AS q FROM documents")
def p07(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.normalize_query(F.col("text"))).alias("q"))


@query("p08_query_terms", f"SELECT doc_id, CAST(len({S.terms(_DOC)}) AS BIGINT) AS n, list_min({S.terms(_DOC)}) AS least FROM documents")
def p08(spark, d):
    t = X.query_terms(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.array_min(t).alias("least"))


@query("p09_rate_limit_payload", """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN true ELSE false END AS limited FROM events""")
def p09(spark, d):
    k = F.col("event_id") % 4
    body = F.when(k == 0, '{"Code":429,"Message":"x","Data":null}').when(k == 1, '{"Code":0,"Data":{"Message":"Quota exceeded"}}').when(k == 2, '{"Code":0,"Data":{"Items":[]}}').otherwise("not json")
    return table(spark, d, "events").select("event_id", P.indicates_rate_limit(body).alias("limited"))


@query("p10_parse_item", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE 'Untitled' END AS title, CAST(length(substr(trim({_DOC}, ' ' || chr(9) || chr(10) || chr(13)), 1, 1200)) AS BIGINT) AS n_content, CASE WHEN doc_id % 3 = 0 THEN 'Article / ' || lang ELSE 'web' END AS source FROM documents")
def p10(spark, d):
    k = F.col("doc_id")
    item = F.to_json(F.struct(F.when(k % 2 == 0, F.concat(F.lit("T"), k.cast("string"))).alias("Title"), F.col("text").alias("ContentText"), F.when(k % 3 == 0, "Article").alias("ContentType"), F.when(k % 3 == 0, F.col("lang")).alias("AuthorName")))
    return docs(spark, d).select("doc_id", P.parse_item(item).alias("i")).select("doc_id", "i.title", F.length("i.content").cast("long").alias("n_content"), "i.source")


@query("p11_split_keys", "SELECT doc_id, lang || '|' || source AS keys FROM documents")
def p11(spark, d):
    raw = F.concat(F.lit(" "), "lang", F.lit(",,\n"), "source", F.lit(" ,"), "lang")
    return docs(spark, d).select("doc_id", F.array_join(X.split_keys(raw), "|").alias("keys"))


@query("p12_clean_answers", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source ELSE lang END AS answers FROM documents")
def p12(spark, d):
    a = F.array(F.concat(F.lit("  "), "lang"), F.lit(" "), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit("")), F.concat("lang", F.lit("\n")))
    return docs(spark, d).select("doc_id", F.array_join(X.clean_answers(a), "|").alias("answers"))


@query("p14_prepare_rows", "SELECT CAST(doc_id AS VARCHAR) AS id, 'Q ' || lang AS question, CASE WHEN doc_id % 4 = 1 THEN source ELSE lang END AS answers, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS data_source FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 4 <> 2")
def p14(spark, d):
    k = F.col("doc_id")
    raw = docs(spark, d).select(k.alias("id"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" Q "), "lang", F.lit(" "))).alias("question"), F.when(k % 4 == 1, F.array(F.lit(" "))).when(k % 4 == 2, F.array().cast("array<string>")).otherwise(F.array("lang", "lang")).alias("golden_answers"), F.when(k % 2 == 0, F.col("source")).alias("data_source"), F.struct(F.struct(F.when(k % 4 == 1, F.array("source", F.concat(F.lit(" "), "source"))).alias("target")).alias("ground_truth")).alias("reward_model"))
    return prep.prepare(raw).select("id", "question", F.array_join("answers", "|").alias("answers"), "data_source")


@query("p15_tokenize", f"SELECT doc_id, CAST(len(regexp_extract_all(lower({_DOC}), '[a-z0-9]+')) AS BIGINT) AS n, md5(array_to_string(regexp_extract_all(lower({_DOC}), '[a-z0-9]+'), ' ')) AS tokens FROM documents")
def p15(spark, d):
    t = X.tokenize(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query("p16_word_count", f"SELECT doc_id, CAST(len({S.words(_DOC)}) AS BIGINT) AS n FROM documents")
def p16(spark, d):
    return docs(spark, d).select("doc_id", X.word_count(F.col("text")).cast("long").alias("n"))


@query("p21_entity_spans", f"SELECT doc_id, CAST(len({S.spans(_DOC)}) AS BIGINT) AS n FROM documents")
def p21(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.entity_spans(F.col("text"))).cast("long").alias("n"))


@query("p22_named_entities", f"SELECT doc_id, CAST(len(list_distinct({S.matches(_DOC, X.NAMED_ENTITY)})) AS BIGINT) AS n FROM documents")
def p22(spark, d):
    return docs(spark, d).select("doc_id", X.named_entity_count(F.col("text")).cast("long").alias("n"))


@query("p23_answer_terms", f"SELECT doc_id, CAST(len({S.answer_terms(_DOC)}) AS BIGINT) AS n FROM documents")
def p23(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.answer_terms(F.col("text"))).cast("long").alias("n"))


@query("p25_token_subset", """
WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(coalesce(text, ''), ' ')[1 + doc_id % 3:], lambda x: x <> '')) AS b FROM documents)
SELECT doc_id, CASE WHEN least(len(a), len(b)) = 0 THEN false WHEN least(len(a), len(b)) = 1 THEN len(list_intersect(a, b)) = 1 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.8 END AS hit FROM t""")
def p25(spark, d):
    w = F.split("text", " ")
    return docs(spark, d).select("doc_id", X.token_subset(F.col("text"), F.array_join(F.slice(w, (F.col("doc_id") % 3 + 1).cast("int"), F.size(w)), " ")).alias("hit"))


@query("p28_suffix_prefix_overlap", "SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS n FROM documents")
def p28(spark, d):
    k = (F.col("doc_id") % 4).cast("int")
    a = F.concat(F.array(F.lit(-1)), F.slice(F.array(*(F.lit(x) for x in (1, 2, 3))), F.lit(1), k))
    return docs(spark, d).select("doc_id", X.suffix_prefix_overlap(a, F.array(*(F.lit(x) for x in (1, 2, 3, 4)))).cast("long").alias("n"))


@query("x05_error_excerpt", f"SELECT doc_id, CAST(length(substr({_DOC}, 1, 400)) AS BIGINT) AS n, length({_DOC}) > 400 AS truncated FROM documents")
def x05(spark, d):
    e = P.excerpt(F.col("text"), 400)
    return docs(spark, d).select("doc_id", F.length(e["excerpt"]).cast("long").alias("n"), e["truncated"].alias("truncated"))


@query("x08_row_key", "SELECT doc_id, source || ':' || doc_id AS row_key FROM documents")
def x08(spark, d):
    return docs(spark, d).select("doc_id", prep.row_key(F.col("source"), F.col("doc_id").cast("string")).alias("row_key"))
