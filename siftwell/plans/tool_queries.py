"""Queries of retrieval, search tools, selection and training sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25_index
from ..operators import metrics as M
from ..operators import prep
from ..operators import retrieval as V
from ..operators import sequence as Q
from ..operators import targeted
from . import sqltext as S
from .derive import EXAMPLES_SQL, TRAJ_SQL, examples, first_words, table, trajectories
from .registry import query, scratch
from .trajectory_queries import rounded

_POSTS = """
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
posts AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avg_len FROM dl), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term)
"""
BM25_SQL = _POSTS + """, q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id AS query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) AS score FROM posts JOIN dl USING (doc_id) JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 4) AS score FROM sc QUALIFY rank <= 3
"""


@query("l01_bm25_topk", BM25_SQL)
def l01(spark, d):
    hits = V.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


@query("l01_block_index", BM25_SQL)
def l01b(spark, d):
    """The same search over a written index of all terms."""
    path = scratch(spark, "index")
    bm25_index.write_index(table(spark, d, "documents"), path)
    hits = bm25_index.search(bm25_index.open_index(spark, path), bm25_index.ask(table(spark, d, "benchmark")))
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


@query("l01_search_status", "SELECT item_id AS query_id, item_id % 5 <> 0 AS ok, CASE WHEN item_id % 5 = 0 THEN 'empty_query' END AS error_type, CAST(CASE WHEN item_id % 5 = 0 THEN 0 ELSE 3 END AS BIGINT) AS n_items FROM benchmark")
def l01s(spark, d):
    b = table(spark, d, "benchmark").withColumn("text", F.when(F.col("item_id") % 5 == 0, "???").otherwise(F.col("text")))
    return V.search_status(b, V.bm25(table(spark, d, "documents"), b))


@query("a16_corpus_stats", "SELECT count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))), 6) AS avg_len FROM documents")
def a16(spark, d):
    return rounded(V.corpus_stats(table(spark, d, "documents")))


@query("a16_document_frequency", _POSTS + "SELECT term, df FROM df")
def a16d(spark, d):
    return V.document_frequency(V.postings(table(spark, d, "documents")))


@query("j01_postings", _POSTS + "SELECT term, doc_id, CAST(tf AS BIGINT) AS tf, CAST(dl AS BIGINT) AS dl FROM posts JOIN dl USING (doc_id)")
def j01(spark, d):
    return V.postings(table(spark, d, "documents")).where("term is not null").select("term", "doc_id", "tf", F.col("dl").cast("long").alias("dl"))


@query("j02_mock_lookup", f"SELECT doc_id AS query_id, true AS ok, CAST(CASE WHEN lang = 'en' THEN 2 WHEN lang = 'de' THEN 5 ELSE 0 END AS BIGINT) AS n_items, lang NOT IN ('en', 'de') AS empty FROM documents")
def j02(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("  Speak "), F.upper("lang")).alias("query"))
    pairs = spark.createDataFrame([("speak EN", 2), ("Speak  de ", 5)], "query string, n_items int")
    return V.mock_lookup(asked, pairs).select("query_id", "ok", F.col("n_items").cast("long").alias("n_items"), "empty")


@query("j04_exclude_selected", "SELECT source, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY source")
def j04(spark, d):
    docs = table(spark, d, "documents")
    key = prep.row_key(F.col("source"), F.col("doc_id").cast("string"))
    return docs.withColumn("k", key).join(docs.where("doc_id % 3 = 0").select(key.alias("k")), "k", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("f15_bridge_score", EXAMPLES_SQL + f""", h AS (SELECT *, list_filter([{S.quoted(prep.BRIDGE_CUES)}], lambda c: contains(lower(question), c)) AS hits FROM ex)
SELECT id, CASE WHEN data_source NOT IN ({S.quoted(prep.MULTIHOP_SOURCES)}) THEN 0 ELSE 4 + 2 * least(len(hits), 5) + CASE WHEN contains(lower(question), ' of ') AND (contains(lower(question), ' who ') OR contains(lower(question), ' which ')) THEN 2 ELSE 0 END + CASE WHEN regexp_matches(question, '[,?]') THEN 1 ELSE 0 END + CASE WHEN len({S.words('question')}) >= 11 THEN 1 ELSE 0 END END::BIGINT AS score,
 CASE WHEN data_source NOT IN ({S.quoted(prep.MULTIHOP_SOURCES)}) THEN '' ELSE array_to_string(list_concat(list_concat(['multihop_source'], list_transform(hits[1:6], lambda c: 'cue:' || c)), list_filter([CASE WHEN contains(lower(question), ' of ') AND (contains(lower(question), ' who ') OR contains(lower(question), ' which ')) THEN 'nested_of_clause' END, CASE WHEN len({S.words('question')}) >= 11 THEN 'long_question' END], lambda x: x IS NOT NULL)), '|') END AS tags FROM h""")
def f15(spark, d):
    return examples(spark, d).select("id", prep.bridge_score(F.col("question"), F.col("data_source")).alias("s")).select("id", F.col("s.score").cast("long").alias("score"), F.array_join("s.tags", "|").alias("tags"))


_NW = f"list_transform(list_filter(answers, lambda a: {S.squeeze('a')} <> ''), lambda a: len({S.words('a')}))"
ALIAS_SQL = EXAMPLES_SQL + f""", al AS (SELECT *, array_to_string(answers, ' ') AS everything FROM ex),
sc AS (SELECT *, CASE WHEN len(answers) >= 2 THEN least(len(answers), 6) ELSE 0 END + CASE WHEN len(list_filter(answers, lambda a: regexp_matches(a, '[^\\x00-\\x7F]'))) > 0 THEN 3 ELSE 0 END + CASE WHEN len(list_filter(answers, lambda a: regexp_matches(a, '[()]'))) > 0 THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(everything, '{X.YEAR}') OR regexp_matches(question, '{X.YEAR}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(everything, '\\b\\d+(?:[.,]\\d+)?\\b') OR {S.cue('question', prep.ALIAS_CUES[:8])} THEN 1 ELSE 0 END
 + CASE WHEN coalesce(list_max({_NW}) - list_min({_NW}), 0) >= 2 THEN 2 ELSE 0 END + CASE WHEN {S.cue('question', prep.ALIAS_CUES)} THEN 1 ELSE 0 END AS score FROM al)
"""


@query("f16_alias_score", ALIAS_SQL + "SELECT id, CAST(score AS BIGINT) AS score FROM sc")
def f16(spark, d):
    return examples(spark, d).select("id", prep.alias_score(F.col("question"), F.col("answers"))["score"].cast("long").alias("score"))


_SELECT = "row_number() OVER (PARTITION BY data_source ORDER BY score DESC, CASE origin WHEN 'dev' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, id) AS rk"


@query("w02_select_candidates", ALIAS_SQL + f", r AS (SELECT *, {_SELECT} FROM sc WHERE score > 0) SELECT id, data_source, CAST(score AS BIGINT) AS score FROM r ORDER BY rk > 16, score DESC, CASE origin WHEN 'dev' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, data_source, id LIMIT 80")
def w02(spark, d):
    scored = examples(spark, d).withColumn("score", prep.alias_score(F.col("question"), F.col("answers"))["score"])
    return prep.select_candidates(scored, 80).select("id", "data_source", F.col("score").cast("long").alias("score"))


_BRIDGE = f"""CASE WHEN data_source NOT IN ({S.quoted(prep.MULTIHOP_SOURCES)}) THEN 0 ELSE 4 + 2 * least(len(hits), 5) + CASE WHEN contains(lower(question), ' of ') AND (contains(lower(question), ' who ') OR contains(lower(question), ' which ')) THEN 2 ELSE 0 END + CASE WHEN regexp_matches(question, '[,?]') THEN 1 ELSE 0 END + CASE WHEN len({S.words('question')}) >= 11 THEN 1 ELSE 0 END END::BIGINT"""


@query("w02_targeted_sets", ALIAS_SQL + f""", h AS (SELECT *, list_filter([{S.quoted(prep.BRIDGE_CUES)}], lambda c: contains(lower(question), c)) AS hits FROM ex), bs AS (SELECT *, {_BRIDGE} AS bridge_score FROM h),
b AS (SELECT 'bridge' AS target, id, data_source, bridge_score AS score, row_number() OVER (ORDER BY rk > 20, bridge_score DESC, o, data_source, id) AS place FROM (SELECT *, CASE origin WHEN 'dev' THEN 0 WHEN 'test' THEN 1 ELSE 2 END AS o, row_number() OVER (PARTITION BY data_source ORDER BY bridge_score DESC, CASE origin WHEN 'dev' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, id) AS rk FROM bs WHERE bridge_score > 0) QUALIFY place <= 60),
a AS (SELECT 'alias' AS target, id, data_source, score, row_number() OVER (ORDER BY rk > 8, score DESC, o, data_source, id) AS place FROM (SELECT *, CASE origin WHEN 'dev' THEN 0 WHEN 'test' THEN 1 ELSE 2 END AS o, row_number() OVER (PARTITION BY data_source ORDER BY score DESC, CASE origin WHEN 'dev' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, id) AS rk FROM sc WHERE score > 0 AND id NOT IN (SELECT id FROM b)) QUALIFY place <= 40)
SELECT target, id, data_source, CAST(score AS BIGINT) AS score FROM b UNION ALL SELECT target, id, data_source, CAST(score AS BIGINT) FROM a""")
def w02t(spark, d):
    bridge, alias = targeted.targeted_sets(examples(spark, d), 60, 40, per_source=20)
    rows = bridge.select(F.lit("bridge").alias("target"), "id", "data_source", "score").unionByName(alias.select(F.lit("alias").alias("target"), "id", "data_source", "score"))
    return rows.withColumn("score", F.col("score").cast("long"))


@query("x11_prepare_dataset", EXAMPLES_SQL + """, p AS (SELECT CAST(id AS VARCHAR) AS id, trim(question) AS question, data_source, CASE WHEN id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM ex WHERE trim(question) <> '' AND id % 10 <> 9),
v AS (SELECT 'dev' AS split, data_source FROM p WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY data_source ORDER BY md5('7:' || id), id) <= 3)
SELECT split, data_source, count(*) AS n FROM (SELECT split, data_source FROM p UNION ALL SELECT split, data_source FROM v) GROUP BY ALL""")
def x11d(spark, d):
    """Raw rows, every tenth without an answer, written as three splits."""
    none = F.array().cast("array<string>")
    raw = examples(spark, d).select(F.col("id"), "question", F.when(F.col("id") % 10 == 9, none).when(F.col("id") % 2 == 0, F.col("answers")).otherwise(none).alias("golden_answers"), "data_source", F.struct(F.struct(F.when(F.col("id") % 10 == 9, none).otherwise(F.col("answers")).alias("target")).alias("ground_truth")).alias("reward_model"))
    return targeted.prepare_splits(raw.where("id % 3 <> 0"), raw.where("id % 3 = 0"), scratch(spark, "splits"), dev_per_source=3, seed=7)


@query("w03_balanced_sample", "SELECT doc_id AS id, source AS data_source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= 10")
def w03(spark, d):
    return prep.balanced_sample(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("data_source")), 10, 42)


@query("w04_shuffle", "SELECT item_id AS id, row_number() OVER (ORDER BY md5('7:' || item_id), item_id) - 1 AS ord FROM benchmark")
def w04(spark, d):
    return prep.shuffled(table(spark, d, "benchmark").select(F.col("item_id").alias("id")), 7)


@query("w05_cyclic_batch", "SELECT b AS batch_pos, (b + 33) % (SELECT count(*) FROM benchmark) AS ord FROM range(64) t(b)")
def w05(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return prep.take_batch(prep.shuffled(rows, 7), 33, 64, rows.count()).select("batch_pos", "ord")


@query("a15_source_counts", "SELECT source AS data_source, count(*) AS n FROM documents GROUP BY source")
def a15(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("data_source")).agg(F.count("*").alias("n"))


@query("w01_group_advantages", "SELECT event_id, round(CASE WHEN min(value) OVER w = max(value) OVER w THEN 0 ELSE greatest(-2, least(2, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6))) END, 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def w01(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("reward"))
    return rounded(M.group_advantages(e, "user_id", standardize=True, clip=2.0).select("event_id", "advantage"))


@query("l03_chunks", "SELECT CAST(doc_id // 64 AS BIGINT) AS chunk, count(*) AS n FROM documents GROUP BY 1")
def l03(spark, d):
    return table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 64).cast("long").alias("chunk")).agg(F.count("*").alias("n"))


@query("l04_union_sources", "SELECT origin, count(*) AS n FROM (SELECT 'documents' AS origin FROM documents UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY origin")
def l04(spark, d):
    a, b = (table(spark, d, n).select(F.lit(n).alias("origin")) for n in ("documents", "benchmark"))
    return a.unionByName(b).groupBy("origin").agg(F.count("*").alias("n"))


@query("f19_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25 OFFSET 100")
def f19(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").offset(100).limit(25)


@query("f18_route_calls", "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'unknown_tool' WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'invalid_arguments' END AS error_type FROM events")
def f18(spark, d):
    k = F.col("event_id")
    calls = table(spark, d, "events").select("event_id", F.col("event_type").alias("tool"), F.when(k % 7 == 0, "  ").when(k % 11 != 0, F.col("props")).alias("query"))
    return V.route_calls(calls, ["click", "view", "error"]).select("event_id", "error_type")


_U = "CAST('0x' || substr(md5('13:' || event_id), 1, 8) AS BIGINT) / 4294967296.0"
FAILURES = {"timeout": 0.1, "rate_limited": 0.05, "empty": 0.1, "noise": 0.05}
_DRAW = f"CASE WHEN {_U} < 0.1 THEN 'timeout' WHEN {_U} < 0.15 THEN 'rate_limited' WHEN {_U} < 0.25 THEN 'empty' WHEN {_U} < 0.3 THEN 'noise' END"


@query("d27_draw_failures", f"SELECT event_id, {_DRAW} AS failure FROM events")
def d27(spark, d):
    return V.draw_failures(table(spark, d, "events").select("event_id"), FAILURES, 13, "event_id").select("event_id", "failure")


@query("d28_failure_results", f"WITH f AS (SELECT event_id, {_DRAW} AS failure FROM events) SELECT event_id, failure IS NULL OR failure IN ('empty', 'noise') AS ok, CAST(CASE WHEN failure = 'rate_limited' THEN 429 ELSE 0 END AS BIGINT) AS status, CASE WHEN failure IN ('timeout', 'rate_limited') THEN failure END AS error_type FROM f")
def d28(spark, d):
    f = V.draw_failures(table(spark, d, "events").select("event_id"), FAILURES, 13, "event_id")
    return f.select("event_id", V.failure_result(F.col("failure")).alias("r")).select("event_id", "r.ok", F.coalesce(F.col("r.status").cast("long"), F.lit(0)).alias("status"), "r.error_type")


@query("a11_search_stats", f"""WITH f AS (SELECT *, {_DRAW} AS failure FROM events),
r AS (SELECT event_type, failure IS NULL OR failure IN ('empty', 'noise') AS ok, coalesce(failure = 'empty', false) AS empty, coalesce(failure = 'noise', false) AS noisy, failure, value FROM f)
SELECT event_type AS backend, count(*) AS count, round(avg(ok::INT), 6) AS success_rate, round(avg(empty::INT), 6) AS empty_rate, round(avg((ok AND noisy)::INT), 6) AS noisy_rate, round(avg((NOT ok AND failure = 'timeout')::INT), 6) AS timeout_rate, round(avg((NOT ok AND failure = 'rate_limited')::INT), 6) AS rate_limited_rate, 0.0::DOUBLE AS error_rate, round(avg(value), 6) AS mean_latency FROM r GROUP BY event_type""")
def a11(spark, d):
    f = V.draw_failures(table(spark, d, "events"), FAILURES, 13, "event_id").withColumn("r", V.failure_result(F.col("failure")))
    e = F.coalesce(F.col("failure") == "empty", F.lit(False))
    results = f.select(F.col("event_type").alias("backend"), "r.ok", "r.error_type", F.when(e, 0).otherwise(3).alias("n_items"), F.coalesce(F.col("failure") == "noise", F.lit(False)).alias("noisy"), F.col("value").alias("latency"))
    return rounded(V.search_stats(results, ["backend"]))


_WRAPPED = ["click", "view", "error"]


@query("a12_merged_metrics", f"""WITH f AS (SELECT *, event_type IN ({S.quoted(_WRAPPED)}) AS w, {_DRAW} AS failure FROM events WHERE event_type IS NOT NULL),
r AS (SELECT event_type, 0 AS depth, CASE WHEN w THEN failure END AS failure, value FROM f UNION ALL SELECT event_type, 1, NULL, value FROM f WHERE w AND failure IS NULL),
g AS (SELECT DISTINCT event_type, 0 AS depth FROM f UNION ALL SELECT DISTINCT event_type, 1 FROM f WHERE w),
s AS (SELECT event_type, depth, count(*)::DOUBLE AS requests, avg((failure IS NULL OR failure IN ('empty', 'noise'))::INT) AS success_rate, avg(coalesce(failure = 'empty', false)::INT) AS empty_rate, avg(coalesce(failure = 'timeout', false)::INT) AS timeout_rate, avg(coalesce(failure = 'rate_limited', false)::INT) AS rate_limit_rate, avg(coalesce(failure = 'noise', false)::INT) AS noise_rate, 0.0::DOUBLE AS error_rate, sum(value) / count(*) AS latency FROM r GROUP BY ALL),
j AS (SELECT event_type, depth, {", ".join(f"coalesce({k}, 0)::DOUBLE AS {k}" for k in V.METRICS)} FROM g LEFT JOIN s USING (event_type, depth))
SELECT repeat('wrapped/', depth) || 'tool/' || event_type || '/' || k AS key, round(v, 6) AS value FROM j UNPIVOT (v FOR k IN ({", ".join(V.METRICS)}))""")
def a12b(spark, d):
    """All event types as backends; three of them are wrapped by injected failures, and get the calls that none hits."""
    wrapped = F.col("event_type").isin(_WRAPPED)
    events = table(spark, d, "events").where("event_type is not null")
    f = V.draw_failures(events, FAILURES, 13, "event_id").withColumn("failure", F.when(wrapped, F.col("failure"))).select("event_type", "failure", F.col("value").alias("latency"))
    calls = f.withColumn("depth", F.explode(F.when(wrapped & F.col("failure").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    r, hit = V.failure_result(F.col("failure")), lambda kind: F.coalesce(F.col("failure") == kind, F.lit(False))
    results = calls.withColumn("r", r).select(F.col("event_type").alias("position"), "depth", "r.ok", "r.error_type", F.when(hit("empty"), 0).when(hit("noise"), 1).otherwise(3).alias("n_items"), hit("noise").alias("noisy"), "latency")
    registered = events.select("event_type").distinct().select(F.col("event_type").alias("position"), F.explode(F.when(wrapped, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("depth"), F.col("event_type").alias("backend"))
    return rounded(V.merged_metrics(registered, results))


@query("a17_smoke_metrics", TRAJ_SQL + "SELECT round(avg(exact_match::INT), 6) AS em, round(avg(valid_format::INT), 6) AS format_rate, round(avg(search_calls), 6) AS search_calls, round(avg((len(list_filter(turns, lambda t: t.role = 'tool' AND NOT t.ok)) > 0)::INT), 6) AS failure_rate FROM tj")
def a17(spark, d):
    t = trajectories(spark, d)
    failed = F.exists("turns", lambda x: F.coalesce((x["role"] == "tool") & ~x["ok"], F.lit(False)))
    return rounded(t.agg(F.avg(F.col("exact_match").cast("double")).alias("em"), F.avg(F.col("valid_format").cast("double")).alias("format_rate"), F.avg("search_calls").alias("search_calls"), F.avg(failed.cast("double")).alias("failure_rate")))


@query("a18_trainer_metrics", "SELECT event_type AS key, round(CASE WHEN event_type = 'error' THEN avg(value) ELSE avg(value) END, 6) AS value FROM events WHERE event_type <> 'view' GROUP BY event_type UNION ALL SELECT 'loss_mean', round(sum(value), 6) FROM events WHERE event_type = 'view'")
def a18(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "view", "loss_mean").otherwise(F.col("event_type")).alias("key"), "value")
    return rounded(M.merge_trainer_metrics(e))


@query("x04_tool_records", "SELECT event_id AS id, 1::BIGINT AS search_calls, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS tool_failures, CAST(NULL AS DOUBLE) AS reward FROM events")
def x04(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(1).cast("long").alias("search_calls"), (F.col("event_type") == "error").cast("long").alias("tool_failures"), F.lit(None).cast("double").alias("reward"))


def samples(spark, d):
    """Documents as two-turn samples: small token lists made of the id."""
    k = F.col("doc_id").cast("int")
    seq = lambda lo, n: F.transform(F.sequence(F.lit(1), n), lambda i: lo + i)
    p1, c1 = seq(k, 2 + k % 3), seq(k + 100, 1 + k % 4)
    p2 = F.concat(p1, c1, seq(k + 200, F.lit(2)))
    c2 = seq(k + 300, 1 + k % 2)
    lp = lambda c: F.transform(c, lambda x: (-x / 1000.0).cast("double"))
    adv = ((k % 5) - 2).cast("double")
    turn = lambda p, c, m: F.struct(p.alias("prompt"), c.alias("completion"), lp(c).alias("logprobs"), adv.alias("advantage"), F.lit(m).alias("mask"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("step"), F.array(turn(p1, c1, 0.0), turn(p2, c2, 1.0)).alias("samples"))


_N1, _M1, _N2 = "(2 + doc_id % 3)", "(1 + doc_id % 4)", "(1 + doc_id % 2)"
_LEN = f"({_N1} + {_M1} + 2 + {_N2})"


@query("d19_build_datum", f"SELECT doc_id AS id, {_LEN} - 1 AS num_tokens, CASE WHEN doc_id % 5 = 2 THEN 0 ELSE {_M1} + {_N2} END AS loss_tokens, round((doc_id % 5 - 2) * ({_M1} + {_N2}), 6)::DOUBLE AS advantage_sum, {_N2} AS mask_tokens FROM documents")
def d19(spark, d):
    b = Q.build_datums(samples(spark, d))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return b.select("id", F.col("num_tokens").cast("long").alias("num_tokens"), F.col("loss_tokens").cast("long").alias("loss_tokens"), total("advantages").alias("advantage_sum"), total("mask").cast("long").alias("mask_tokens"))


@query("d20_trainable", "SELECT count(*) AS n FROM documents WHERE doc_id % 5 <> 2")
def d20(spark, d):
    return Q.trainable(Q.build_datums(samples(spark, d))).agg(F.count("*").alias("n"))


@query("d21_turn_mask", "SELECT doc_id, (quality = 1 OR toxic = 1) AND doc_id % 3 > 0 AS selected FROM labels")
def d21(spark, d):
    t = table(spark, d, "labels")
    return t.select("doc_id", Q.turn_selected("final_and_credited", "positive_advantage", F.col("quality") == 1, F.col("toxic") == 1, F.col("doc_id") % 3, F.lit(0.0), F.lit(False)).alias("selected"))


def lengths(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("step"), F.col("n_chars").cast("int").alias("num_tokens"))


#: First-fit decreasing by a walk over batches: a batch's first datum fixes its length.
_PACK = """
WITH RECURSIVE l AS (SELECT doc_id AS id, doc_id % 10 AS step, CAST(n_chars AS INT) AS num_tokens FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY num_tokens DESC, id) - 1 AS pos, CASE WHEN num_tokens <= 2000 THEN 32 ELSE 64000 // num_tokens END AS cap FROM l WHERE num_tokens <= 8192),
b AS (SELECT step, pos, cap, 0 AS batch FROM r WHERE pos = 0 UNION ALL SELECT r.step, r.pos, r.cap, b.batch + 1 FROM b JOIN r ON r.step = b.step AND r.pos = b.pos + b.cap),
p AS (SELECT r.step, r.id, r.num_tokens, b.batch, 'ok' AS status FROM r JOIN b ON r.step = b.step AND r.pos >= b.pos AND r.pos < b.pos + b.cap
  UNION ALL SELECT step, id, num_tokens, NULL, CASE WHEN num_tokens IS NULL THEN 'no_length' ELSE 'too_long' END FROM l WHERE num_tokens > 8192 OR num_tokens IS NULL)
"""


@query("d22_pack_micro_batches", _PACK + "SELECT step, id, num_tokens, batch, status FROM p")
def d22(spark, d):
    return Q.pack_micro_batches(lengths(spark, d))


@query("a08_packing_metrics", _PACK + ", m AS (SELECT step, batch, count(*) AS items, sum(num_tokens)::BIGINT AS tokens, (max(num_tokens) * count(*))::BIGINT AS padded FROM p WHERE batch IS NOT NULL GROUP BY ALL) SELECT step, sum(items)::BIGINT AS datums, count(*) AS micro_batches, sum(tokens)::BIGINT AS tokens, sum(padded)::BIGINT AS padded_tokens, max(padded) AS max_padded_tokens FROM m GROUP BY step")
def a08p(spark, d):
    return M.packing_metrics(Q.pack_micro_batches(lengths(spark, d)))


@query("d23_weight_batches", "SELECT lang, count(*) AS n, round(sum(w), 4) AS weight FROM (SELECT lang, (count(*) OVER (PARTITION BY lang, source))::DOUBLE / count(*) OVER (PARTITION BY lang) AS w FROM documents) GROUP BY lang")
def d23(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", F.array(F.lit(1.0)).alias("advantages"))
    w = Q.weight_for_global_mean(rows, ["lang", "source"], ["lang"])
    return w.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum(F.col("advantages")[0].cast("double")), 4).alias("weight"))


@query("d24_align_logprobs", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE -0.5 END + -0.25::DOUBLE AS total FROM events")
def d24(spark, d):
    model = F.array(F.lit(None).cast("double"), F.when(F.col("event_id") % 3 != 0, -0.5), F.lit(-0.25))
    got = Q.align_logprobs(model, F.array(F.lit(False), F.lit(True)))
    return table(spark, d, "events").select("event_id", F.aggregate(got, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("j08_attach_logprobs", f"""WITH n AS (SELECT doc_id AS id, {_LEN} AS len, {_N1} AS n1, doc_id % 5 - 2 AS adv FROM documents),
l AS (SELECT doc_id AS id, count(*) AS partners, any_value(toxic) AS toxic, any_value(quality) AS quality FROM labels GROUP BY doc_id),
s AS (SELECT n.*, l.quality, CASE WHEN partners IS NULL THEN 'missing' WHEN partners > 1 THEN 'repeated' WHEN toxic = 1 THEN 'length' WHEN quality = 0 AND n.id % 7 = 0 AND adv <> 0 THEN 'lacks_a_value' ELSE 'ok' END AS status FROM n LEFT JOIN l USING (id))
SELECT id, status AS reference_status, CASE WHEN status = 'ok' THEN round(-(len * (len - 1) / 2) / 100.0 + CASE WHEN quality = 0 THEN 0.01 ELSE 0 END + CASE WHEN quality = 0 AND id % 7 = 0 THEN (len - 1) / 100.0 ELSE 0 END, 6) END AS total FROM s""")
def j08(spark, d):
    """Datums of the documents and log-probabilities for the labelled ones, joined by buckets."""
    k = F.col("doc_id").cast("int")
    size = 2 + k % 3 + 1 + k % 4 + 2 + 1 + k % 2
    value = lambda i: F.when((i == 0) | ((F.col("quality") == 0) & ((i == 1) | ((k % 7 == 0) & (i == size - 1)))), F.lit(None).cast("double")).otherwise(-i / 100.0)
    model = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.transform(F.sequence(F.lit(0), size - 1 - F.col("toxic")), value).alias("logprobs"))
    datums = Q.build_datums(samples(spark, d)).select("id", "target_tokens", "advantages")
    got = Q.attach_logprobs(Q.write_bucketed(datums, buckets=8), Q.write_bucketed(model, buckets=8), "reference", "advantages", strict=False)
    return got.select("id", "reference_status", F.round(F.aggregate("reference", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("d25_gate_mask", "SELECT event_id, CAST(CASE WHEN value / 100 >= 0.3 THEN 1 ELSE 0 END AS BIGINT) AS kept FROM events")
def d25(spark, d):
    m = Q.gate_mask(F.array(F.lit(1.0)), F.array(F.col("value") / 100), 0.3)
    return table(spark, d, "events").select("event_id", m[0].cast("long").alias("kept"))


_TOK = "SELECT ln(0.2 + (event_id % 7) / 10.0) AS cur, ln(0.5) AS old, (event_id % 3) - 1.0 AS adv, ln(0.4) AS ref, ln(0.6) AS teacher, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS mask FROM events"


@query("d26_loss_statistics", f"""WITH t AS ({_TOK}), r AS (SELECT *, exp(cur - old) AS ratio FROM t), u AS (SELECT *, least(greatest(ratio, 0.8), 1.2) AS used FROM r)
SELECT round((-sum(used * adv) + 0.1 * sum(CASE WHEN adv <> 0 THEN 0.5 * (cur - ref) ** 2 ELSE 0 END) + 0.5 * -avg(cur) FILTER (mask <> 0)) / count(*), 6) AS loss_mean, count(*) FILTER (adv <> 0) AS train_tokens, round(avg(ratio) FILTER (adv <> 0), 6) AS ratio_mean, round(max(ratio) FILTER (adv <> 0), 6) AS ratio_max, round(avg((ratio <> used)::INT) FILTER (adv <> 0), 6) AS clip_fraction, count(*) FILTER (mask <> 0) AS masked_tokens, round(avg(abs(cur - teacher)) FILTER (mask <> 0), 6) AS gap_mean FROM u""")
def d26(spark, d):
    k = F.col("event_id")
    tokens = table(spark, d, "events").select(F.log(0.2 + (k % 7) / 10.0).alias("cur"), F.log(F.lit(0.5)).alias("old"), ((k % 3) - 1.0).alias("adv"), F.log(F.lit(0.4)).alias("ref"), F.log(F.lit(0.6)).alias("teacher"), F.when(k % 4 == 0, 1).otherwise(0).alias("mask"))
    return rounded(Q.loss_statistics(tokens, kl=0.1, clip=0.2, distil=0.5).select("loss_mean", "train_tokens", "ratio_mean", "ratio_max", "clip_fraction", "masked_tokens", "gap_mean"))
