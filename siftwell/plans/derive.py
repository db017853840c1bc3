"""Trajectories, examples and token samples derived from the test tables, in Spark and in SQL.

The tables hold no trajectories, so conversations are read as such: an assistant turn
that a user turn follows is a search, the user turn its observation, and the last
assistant turn the final answer. Texts are taken whole; only titles, known answers and
search queries, which are short by nature, are made of first words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.turns import TURNS

SUFFIXES = ["director", "born 1912", "wife of", "country"]
SOURCES = ["nq", "hotpotqa", "2wikimultihopqa", "musique"]
ASKS = [" Who is the director of the film?", " When was the wife of Dexter born?", "", " Which country is it, and who won?"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_words(c, n: int):
    return F.substring_index(c, " ", n)


def pick(values: list[str], at):
    return F.get(F.array(*(F.lit(v) for v in values)), at)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation with an assistant turn; its turns are gathered, as a record holds them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumns({"after": F.lead("role").over(w), "before": F.lag("role").over(w), "heard": F.lag("text").over(w)})
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    kind = F.when((F.col("role") == "assistant") & (F.col("after") == "user"), "search").when(F.col("role") == "assistant", "final").when(F.col("before") == "assistant", "tool")
    query = F.when(conv % 6 == 0, F.concat(F.lit("same query director "), conv.cast("string"))).otherwise(F.concat(F.when(conv % 2 == 1, F.coalesce(first_words(F.col("heard"), 3), F.lit(""))).otherwise(first_words(text, 4)), F.lit(" "), pick(SUFFIXES, (turn % 4).cast("int"))))
    answer = F.when(conv % 8 == 0, "1912").when(conv % 8 == 1, "Dexter or Barry").when(conv % 8 == 2, "Dexter King").otherwise(text)
    final = F.when(conv % 5 != 0, F.concat(F.lit("Reasoning.\n\nAnswer: "), answer)).otherwise(text)
    item = F.struct(F.lit(None).cast("string").alias("id"), first_words(text, 2).alias("title"), text.alias("content"), F.lit(None).cast("string").alias("url"), F.lit("src").alias("source"), F.lit(None).cast("double").alias("score"))
    none = F.array().cast("array<struct<id:string,title:string,content:string,url:string,source:string,score:double>>")
    tool = F.col("kind") == "tool"
    event = F.struct(
        turn.alias("ord"), F.when(tool, "tool").otherwise("assistant").alias("role"), F.when(F.col("kind") == "final", final).when(~tool, text).alias("text"), F.when(F.col("kind") == "search", "tool").when(F.col("kind") == "final", "answer").alias("parsed_kind"),
        F.when(F.col("kind") == "search", F.struct(F.lit("search").alias("name"), query.alias("query"))).alias("tool_call"), F.when(tool, turn % 5 != 0).alias("ok"), F.when(tool & (turn % 9 != 0), F.when(conv % 7 == 0, none).otherwise(F.array(item))).alias("items"),
        F.when(tool, F.concat(text, F.lit(" 1912"))).alias("observation"), F.when(tool & (turn % 5 == 0), F.when(conv % 3 == 0, "timeout").when(conv % 3 == 1, "rate_limited").otherwise("http")).alias("error_type"), F.when(tool, (turn * 10 + conv % 7).cast("double")).alias("latency"),
    )
    first = F.min_by(F.when(F.col("role") == "user", text), F.when(F.col("role") == "user", turn))
    g = t.withColumn("kind", kind).withColumn("event", F.when(F.col("kind").isNotNull(), event)).groupBy("conv_id").agg(first.alias("asked"), F.array_sort(F.collect_list("event")).alias("events"), F.count_if(F.col("kind") == "search").cast("int").alias("search_calls"))
    g = g.where(F.exists("events", lambda e: e["role"] == "assistant"))
    asked = F.coalesce(F.col("asked"), F.lit(""))
    return g.select(
        conv.alias("id"), F.concat(asked, pick(ASKS, (conv % 4).cast("int"))).alias("question"), F.array(F.when(conv % 8 == 0, "October 2, 1912").when(conv % 8 == 2, "Dexter").otherwise(first_words(asked, 3)), F.concat(F.lit("the "), conv.cast("string"))).alias("answers"),
        pick(SOURCES, (conv % 4).cast("int")).alias("data_source"), F.transform("events", lambda e: F.struct(*(e[c].alias(c) for c in ("role", "text", "parsed_kind", "tool_call", "ok", "items", "observation", "error_type", "latency")))).cast(TURNS).alias("turns"),
        (conv % 3 == 0).alias("exact_match"), (conv % 5 != 0).alias("valid_format"), "search_calls", F.lit(0).alias("tool_failures"), F.when(conv % 10 == 5, "max_search_calls").when(conv % 5 == 0, "invalid_format").otherwise("answer").alias("stop_reason"),
        F.when(conv % 5 == 0, -0.1).when(conv % 3 == 0, 1.0).otherwise(0.0).alias("reward"), F.floor(conv / 4).cast("long").alias("question_index"),
    )


def _sql_words(c: str, n: int) -> str:
    return f"array_to_string(string_split({c}, ' ')[1:{n}], ' ')"


def _sql_pick(values: list[str], at: str) -> str:
    return "(" + "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[1 + {at}]"


#: Common table expressions that end in tj, the same trajectories; a turn's query is a plain field there.
TRAJ_SQL = f"""
WITH tj0 AS (SELECT *, lead(role) OVER w AS after, lag(role) OVER w AS before, lag(text) OVER w AS heard FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
tj1 AS (SELECT *, CASE WHEN role = 'assistant' AND after = 'user' THEN 'search' WHEN role = 'assistant' THEN 'final' WHEN before = 'assistant' THEN 'tool' END AS kind FROM tj0),
tj2 AS (SELECT conv_id, turn, role AS was, text AS said, kind,
  CASE WHEN kind = 'tool' THEN 'tool' ELSE 'assistant' END AS role,
  CASE WHEN kind = 'search' THEN 'tool' WHEN kind = 'final' THEN 'answer' END AS parsed_kind,
  CASE WHEN kind = 'search' THEN CASE WHEN conv_id % 6 = 0 THEN 'same query director ' || conv_id ELSE CASE WHEN conv_id % 2 = 1 THEN coalesce({_sql_words('heard', 3)}, '') ELSE {_sql_words('text', 4)} END || ' ' || {_sql_pick(SUFFIXES, 'turn % 4')} END END AS query,
  CASE WHEN kind = 'final' THEN CASE WHEN conv_id % 5 <> 0 THEN 'Reasoning.' || chr(10) || chr(10) || 'Answer: ' || CASE WHEN conv_id % 8 = 0 THEN '1912' WHEN conv_id % 8 = 1 THEN 'Dexter or Barry' WHEN conv_id % 8 = 2 THEN 'Dexter King' ELSE text END ELSE text END WHEN kind <> 'tool' THEN text END AS text,
  CASE WHEN kind = 'tool' THEN turn % 5 <> 0 END AS ok,
  CASE WHEN kind = 'tool' AND turn % 9 <> 0 THEN CASE WHEN conv_id % 7 = 0 THEN [] ELSE [{{'title': {_sql_words('text', 2)}, 'source': 'src', 'content': text}}] END END AS items,
  CASE WHEN kind = 'tool' THEN text || ' 1912' END AS observation,
  CASE WHEN kind = 'tool' AND turn % 5 = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'timeout' WHEN conv_id % 3 = 1 THEN 'rate_limited' ELSE 'http' END END AS error_type,
  CASE WHEN kind = 'tool' THEN CAST(turn * 10 + conv_id % 7 AS DOUBLE) END AS latency FROM tj1),
tj3 AS (SELECT conv_id, arg_min(said, turn) FILTER (was = 'user') AS asked, count(*) FILTER (kind = 'search') AS search_calls,
  list({{'role': role, 'text': text, 'parsed_kind': parsed_kind, 'query': query, 'ok': ok, 'items': items, 'observation': observation, 'error_type': error_type, 'latency': latency}} ORDER BY turn) FILTER (kind IS NOT NULL) AS turns
  FROM tj2 GROUP BY conv_id),
tj AS (SELECT conv_id AS id, coalesce(asked, '') || {_sql_pick(ASKS, 'conv_id % 4')} AS question,
  [CASE WHEN conv_id % 8 = 0 THEN 'October 2, 1912' WHEN conv_id % 8 = 2 THEN 'Dexter' ELSE {_sql_words("coalesce(asked, '')", 3)} END, 'the ' || conv_id] AS answers,
  {_sql_pick(SOURCES, 'conv_id % 4')} AS data_source, turns, conv_id % 3 = 0 AS exact_match, conv_id % 5 <> 0 AS valid_format, search_calls,
  CASE WHEN conv_id % 10 = 5 THEN 'max_search_calls' WHEN conv_id % 5 = 0 THEN 'invalid_format' ELSE 'answer' END AS stop_reason,
  CAST(CASE WHEN conv_id % 5 = 0 THEN -0.1 WHEN conv_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS reward, CAST(floor(conv_id / 4) AS BIGINT) AS question_index
  FROM tj3 WHERE len(list_filter(turns, lambda t: t.role = 'assistant')) > 0)
"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as question rows: the text with a cue, and answers of several kinds."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(k.alias("id"), F.concat(F.coalesce("text", F.lit("")), pick(ASKS, (k % 4).cast("int"))).alias("question"), F.array(first_words(F.coalesce("text", F.lit("")), 2), F.when(k % 3 == 0, "October 2, 1912").when(k % 3 == 1, first_words(F.coalesce("text", F.lit("")), 5)).otherwise("(Dexter)")).alias("answers"), pick(SOURCES, (k % 4).cast("int")).alias("data_source"), pick(["dev", "test", "train"], (k % 3).cast("int")).alias("origin"))


EXAMPLES_SQL = f"""
WITH ex AS (SELECT doc_id AS id, coalesce(text, '') || {_sql_pick(ASKS, 'doc_id % 4')} AS question,
  [{_sql_words("coalesce(text, '')", 2)}, CASE WHEN doc_id % 3 = 0 THEN 'October 2, 1912' WHEN doc_id % 3 = 1 THEN {_sql_words("coalesce(text, '')", 5)} ELSE '(Dexter)' END] AS answers,
  {_sql_pick(SOURCES, 'doc_id % 4')} AS data_source, {_sql_pick(["dev", "test", "train"], 'doc_id % 3')} AS origin FROM documents)
"""

