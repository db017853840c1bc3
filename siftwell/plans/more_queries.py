"""Queries of sinks, protocol, replay, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import protocol as P
from ..functions import text as X
from ..operators import backends, credit, fit
from ..operators import diagnostics as D
from ..operators import metrics as M
from ..operators import prep, replay
from ..operators import rewards as R
from ..sources import jsonl, records
from ..streaming import steps, windows
from . import reports
from . import sqltext as S
from . import trajectory_queries as Q
from .derive import EXAMPLES_SQL, TRAJ_SQL, examples, table, trajectories
from .registry import query, scratch
from .trajectory_queries import rounded


@query("s10_metrics_file", TRAJ_SQL + "SELECT 'records' AS kind, round((SELECT avg(em) FROM (SELECT avg(exact_match::INT) AS em FROM tj GROUP BY data_source)), 6) AS em_macro, round(avg(valid_format::INT), 6) AS format_rate FROM tj UNION ALL SELECT 'summary', 0.25::DOUBLE, 0.75::DOUBLE")
def s10(spark, d):
    plain, summed = scratch(spark, "metrics"), scratch(spark, "metrics")
    t = trajectories(spark, d).withColumns({"id": F.col("id").cast("string"), "type": F.lit("trajectory")})
    jsonl.write_records(t, plain)
    lines = ['{"type":"trajectory","id":"1"}', '{"type":"summary","metrics":{"em/macro":0.5,"format/rate":0.5}}', '{"type":"summary","metrics":{"em/macro":0.25,"format/rate":0.75}}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(summed)
    return rounded(jsonl.metric_series(spark, [("records", plain), ("summary", summed)]).select(F.col("label").alias("kind"), "em_macro", "format_rate"))


@query("k01_record_roundtrip", TRAJ_SQL + "SELECT count(*) AS n, CAST(sum(len(turns)) AS BIGINT) AS turns, count(*) FILTER (exact_match) AS exact FROM tj")
def k01(spark, d):
    path = scratch(spark, "records")
    jsonl.write_records(trajectories(spark, d).withColumn("id", F.col("id").cast("string")), path)
    return jsonl.read_records(spark, path).agg(F.count("*").alias("n"), F.sum(F.size("turns")).alias("turns"), F.count_if("exact_match").alias("exact"))


@query("t01_unknown_keys", TRAJ_SQL + """SELECT CAST(id AS VARCHAR) AS id, data_source AS own_key, 'kept ' || stop_reason AS meta_key, array_to_string(list_transform(turns, lambda t: t.role || ':' || length(coalesce(t.text, ''))), ' ') AS turn_keys,
 CAST(len(list_filter(turns, lambda t: t.role = 'tool')) AS BIGINT) AS marked, round(reward + 1, 6) AS reward, CAST(len(turns) AS BIGINT) AS n_turns FROM tj""")
def t01(spark, d):
    """Records with keys that no schema names are written, read, changed, written and read once more."""
    first, second = scratch(spark, "records"), scratch(spark, "records")
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.struct(F.concat(t["role"], F.lit(":"), F.length(F.coalesce(t["text"], F.lit(""))).cast("string")).alias("seen")).alias("own_turn_key")))
    meta = F.struct(F.col("stop_reason").alias("stop_reason"), F.array(F.concat(F.lit("kept "), F.col("stop_reason"))).alias("own_meta_key"))
    lines = trajectories(spark, d).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "question", "reward", F.struct("data_source").alias("own_key"), turns.alias("turns"), meta.alias("metadata"))).alias("value"))
    lines.write.text(first)
    read = records.typed(records.read(spark, first)).withColumn("reward", F.col("reward") + 1)
    marks = F.transform("turns", lambda t: F.when(t["role"] == "tool", F.lit("seen").cast("variant")))
    records.write(records.mark_turns(records.update(read, ["reward"]), "mark", marks), second)
    get = lambda path, kind="string": F.variant_get("record", path, kind)
    each = F.transform(get("$.turns", "array<variant>"), lambda t: F.struct(F.try_variant_get(t, "$.own_turn_key.seen", "string").alias("key"), F.try_variant_get(t, "$.mark", "string").alias("mark")))
    back = records.read(spark, second).withColumn("t", each)
    return back.select(get("$.id").alias("id"), get("$.own_key.data_source").alias("own_key"), get("$.metadata.own_meta_key[0]").alias("meta_key"), F.array_join(F.transform("t", lambda t: t["key"]), " ").alias("turn_keys"), F.size(F.filter("t", lambda t: t["mark"] == "seen")).cast("long").alias("marked"), F.round(get("$.reward", "double"), 6).alias("reward"), F.size("t").cast("long").alias("n_turns"))


@query("k05_step_files", "SELECT CAST(doc_id % 4 AS BIGINT) AS step, count(*) AS n FROM documents GROUP BY 1")
def k05(spark, d):
    path = scratch(spark, "steps")
    jsonl.write_steps(table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("step")), path)
    return spark.read.schema("doc_id long, step long").json(path).groupBy("step").agg(F.count("*").alias("n"))


@query("k05_step_stream", TRAJ_SQL + """, a AS (SELECT question_index % 5 AS step, question_index, id, exact_match, CASE WHEN min(reward) OVER g = max(reward) OVER g THEN 0 ELSE reward - avg(reward) OVER g END AS advantage FROM tj WINDOW g AS (PARTITION BY question_index)),
m AS (SELECT step, avg(exact_match::INT) AS em FROM a GROUP BY step)
SELECT a.step, a.id, round(advantage, 6)::DOUBLE AS advantage, a.step = (SELECT step FROM m ORDER BY em DESC, step LIMIT 1) AS best FROM a""")
def k05s(spark, d):
    """Trajectories arrive in three parts: first with wrong rewards for some, then the late ones, then all again."""
    path, out, checkpoint = scratch(spark, "steps"), scratch(spark, "stated"), scratch(spark, "stream")
    t = trajectories(spark, d).select((F.col("question_index") % 5).alias("step"), "question_index", "id", "reward", "exact_match")
    wrong = F.when(F.col("id") % 5 == 1, F.col("reward") - 2).otherwise(F.col("reward"))
    first = t.where("id % 3 <> 2").withColumns({"version": F.lit(1), "reward": wrong})
    for k, part in enumerate((first, t.where("id % 3 = 2").withColumn("version", F.lit(1)), t.withColumn("version", F.lit(2)))):
        part.coalesce(2).write.json(f"{path}/part={k}")
        steps.follow_steps(spark, f"{path}/*", out, checkpoint, files_per_trigger=2).awaitTermination()
    rows = steps.stated(spark, out)
    return rows.join(steps.best_step(rows).select("step", "best"), "step").select("step", "id", F.round("advantage", 6).alias("advantage"), "best")


@query("p04_tool_content", f"SELECT doc_id, CAST(length(lang || chr(10) || chr(10) || '{P.REMINDER}') AS BIGINT) AS n FROM documents")
def p04(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(P.tool_content(F.col("lang"))).cast("long").alias("n"))


@query("p05_messages", "SELECT item_id, 2::BIGINT AS n, 'system' AS first_role, md5(text) AS asked FROM benchmark")
def p05(spark, d):
    m = P.initial_messages(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(m).cast("long").alias("n"), m[0]["role"].alias("first_role"), F.md5(m[1]["content"]).alias("asked"))


_BLOCK = "'[' || {i} || '] Title: ' || lang || chr(10) || '    Content: ' || coalesce(text, '') || chr(10) || '    Source: ' || source || chr(10) || '    URL: '"


def _items(n: int):
    one = F.struct(F.lit(None).cast("string").alias("id"), F.col("lang").alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.lit("").alias("url"), F.col("source").alias("source"), F.lit(None).cast("double").alias("score"))
    return F.array(*(one for _ in range(n)))


@query("p06_format_items", f"SELECT doc_id, md5({_BLOCK.format(i=1)} || chr(10) || chr(10) || {_BLOCK.format(i=2)}) AS said FROM documents")
def p06(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(P.format_items(_items(2)), "\n\n")).alias("said"))


@query("d29_fit_observation", f"""WITH b AS (SELECT doc_id, len({S.words(_BLOCK.format(i=1))}) AS n, len({S.words("'" + P.REMINDER + "'")}) AS r FROM documents)
SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 WHEN 3 * n + r <= 75 THEN 3 WHEN 2 * n + r <= 75 THEN 2 WHEN n + r <= 75 THEN 1 ELSE 0 END AS BIGINT) AS blocks FROM b""")
def d29(spark, d):
    blocks = P.observation_blocks(F.col("doc_id") % 5 != 0, _items(3), F.lit("timeout"))
    got = P.fit_blocks(blocks, X.word_count, 75)
    return table(spark, d, "documents").select("doc_id", F.when(got.isNull(), 0).otherwise(F.size(F.split(got, "\n\n"))).cast("long").alias("blocks"))


_CALLED = "<tool_call><function=search><parameter=query>q</parameter></function></tool_call>"


@query("d30_replay", """WITH o AS (SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t, conv_id % 4 AS k FROM conversations WHERE role = 'assistant'),
p AS (SELECT id, t, CASE WHEN k = 0 THEN 'tool' WHEN k = 1 AND t < 1 THEN 'tool' WHEN k = 2 AND t < 1 THEN 'tool' WHEN k = 2 THEN 'invalid' ELSE 'answer' END AS kind FROM o),
s AS (SELECT id, min(t) FILTER (NOT (kind = 'tool' AND t < 2 AND t + 1 < 6)) AS stop_turn, count(*) FILTER (kind = 'tool' AND t < 2 AND t + 1 < 6) AS n FROM p GROUP BY id)
SELECT s.id, CASE p.kind WHEN 'answer' THEN 'answer' WHEN 'invalid' THEN 'invalid_format' WHEN 'tool' THEN 'max_search_calls' END AS stop_reason, CAST(coalesce(stop_turn, n) AS BIGINT) AS search_calls FROM s LEFT JOIN p ON p.id = s.id AND p.t = s.stop_turn""")
def d30(spark, d):
    from pyspark.sql import Window

    k, t = F.col("conv_id") % 4, F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    text = F.when(k == 0, _CALLED).when((k.isin(1, 2)) & (F.col("t") < 1), _CALLED).when(k == 2, "<tool_call> broken").otherwise("Answer: x")
    outputs = table(spark, d, "conversations").where("role = 'assistant'").withColumn("t", t).select(F.col("conv_id").alias("id"), F.col("t").alias("turn"), text.alias("text"))
    return replay.replay(outputs, max_search_calls=2).select("id", "stop_reason", F.col("search_calls").cast("long").alias("search_calls"))


_SUFFIX = "chr(10) || chr(10) || '" + P.REMINDER + "'"


@query("d29_two_budgets", f"""WITH b AS (SELECT doc_id, n_chars % 500 AS used, generate_subscripts(string_split(coalesce(text, ''), '. '), 1) AS k, strlen(unnest(string_split(coalesce(text, ''), '. '))) AS n FROM documents),
c AS (SELECT doc_id, used, k, (sum(n) OVER (PARTITION BY doc_id ORDER BY k) + 2 * (k - 1) + strlen({_SUFFIX}) + 3)::BIGINT // 4 AS tokens FROM b),
f AS (SELECT doc_id, any_value(used) AS used, count(*) FILTER (tokens <= 400 AND used + tokens <= 700) AS n_fit, max(tokens) FILTER (tokens <= 400 AND used + tokens <= 700) AS message_tokens FROM c GROUP BY doc_id)
SELECT doc_id, CAST(n_fit AS INTEGER) AS n_fit, message_tokens, used + message_tokens AS next_tokens, md5(array_to_string((string_split(coalesce(text, ''), '. '))[1:n_fit], chr(10) || chr(10))) AS content FROM f JOIN documents USING (doc_id)""")
def d29b(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\\. ").alias("blocks"), (F.col("n_chars") % 500).alias("used_tokens"))
    got = fit.fit_observations(docs, tool_tokens=400, trajectory_tokens=700)
    return got.select("doc_id", "n_fit", "message_tokens", "next_tokens", F.md5(F.coalesce("content", F.lit(""))).alias("content"))


_TOKENS = "(strlen({}) + 3) // 4"
_REPLAY = f"""WITH RECURSIVE a AS (SELECT conv_id AS id, role, text, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS heard, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS opening FROM conversations),
b AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS t, id % 8 AS k, {_TOKENS.format("text")} AS n, string_split(coalesce(heard, ''), '. ') AS blocks, {_TOKENS.format("opening")} AS start_tokens FROM a WHERE role = 'assistant'),
o AS (SELECT id, t, n, start_tokens, CASE WHEN k IN (1, 7) AND t > 0 THEN 'answer' WHEN k = 2 AND t > 0 THEN 'invalid' ELSE 'tool' END AS kind, k <> 5 AS rebuilt, CASE WHEN k = 0 THEN 1 ELSE 3 END AS ms, CASE WHEN k = 3 THEN 2 ELSE 6 END AS mt, CASE WHEN k = 4 THEN 10 ELSE 120 END AS tool, CASE WHEN k = 6 THEN start_tokens + t WHEN k = 7 THEN 400 ELSE 4000 END AS ctx0,
  list_transform(range(1, len(blocks) + 1), lambda m: {_TOKENS.format(f"array_to_string(blocks[1:m], chr(10) || chr(10)) || {_SUFFIX}")}) AS sizes FROM b),
l AS (SELECT id, any_value(start_tokens) AS start_tokens, max(ctx0) AS ctx FROM o GROUP BY id),
r AS (SELECT id, 0::BIGINT AS t, start_tokens::BIGINT AS tokens, 0 AS searches, NULL::VARCHAR AS stop, NULL::INTEGER AS halt, 0::BIGINT AS blocks FROM l
  UNION ALL SELECT id, t + 1, CASE WHEN now IS NULL THEN tokens + n + sizes[fits] ELSE tokens END, CASE WHEN now = 'max_trajectory_tokens' OR NOT goes THEN searches ELSE searches + 1 END, now, CASE WHEN now IS NOT NULL THEN t::INTEGER END, CASE WHEN now IS NULL THEN blocks + fits ELSE blocks END
  FROM (SELECT *, CASE WHEN tokens >= ctx THEN 'max_trajectory_tokens' WHEN goes AND NOT rebuilt THEN 'prompt_reconstruction_failed' WHEN goes AND fits = 0 THEN 'tool_observation_budget' WHEN goes THEN NULL WHEN kind = 'answer' THEN 'answer' WHEN kind = 'invalid' THEN 'invalid_format' WHEN searches >= ms THEN 'max_search_calls' ELSE 'max_assistant_turns' END AS now
    FROM (SELECT r.id, r.t, r.tokens, r.searches, r.blocks, o.n, o.kind, o.rebuilt, o.ms, o.sizes, l.ctx, o.kind = 'tool' AND r.searches < o.ms AND r.t + 1 < o.mt AS goes,
      len(list_filter(range(1, len(o.sizes) + 1), lambda m: len(list_filter(o.sizes[1:m], lambda z: z > o.tool OR r.tokens + o.n + z > l.ctx)) = 0)) AS fits
      FROM r JOIN o ON o.id = r.id AND o.t = r.t JOIN l ON l.id = r.id WHERE r.stop IS NULL) x) y),
z AS (SELECT r.*, ctx FROM r JOIN l USING (id) QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY r.t DESC) = 1)
SELECT id, CASE WHEN stop IS NULL AND tokens >= ctx THEN 'max_trajectory_tokens' ELSE stop END AS stop_reason, halt AS stop_turn, searches AS search_calls, tokens, CAST(blocks AS BIGINT) AS blocks FROM z"""


@query("d30_replay_budgets", _REPLAY)
def d30b(spark, d):
    """All seven reasons: the conversations' texts with their lengths, searches and limits by the id."""
    from pyspark.sql import Window

    w, k, t = Window.partitionBy("conv_id").orderBy("turn"), F.col("conv_id") % 8, F.col("t")
    count = lambda c: F.floor((F.octet_length(c) + 3) / 4)
    c = table(spark, d, "conversations").withColumns({"heard": F.lead("text").over(w), "opening": F.first("text").over(w)}).where("role = 'assistant'").withColumn("t", F.row_number().over(w) - 1)
    said = F.when(k.isin(1, 7) & (t > 0), "Answer: x").when((k == 2) & (t > 0), "<tool_call> broken").otherwise(_CALLED)
    ctx = F.when(k == 6, count(F.col("opening")) + t).when(k == 7, 400).otherwise(4000)
    outputs = c.select(F.col("conv_id").alias("id"), t.alias("turn"), said.alias("text"), count(F.col("text")).alias("tokens"), fit.prefix_sizes(F.split(F.coalesce("heard", F.lit("")), "\\. "), count).alias("sizes"), (k != 5).alias("rebuilt"), count(F.col("opening")).alias("start_tokens"), F.when(k == 0, 1).otherwise(3).alias("ms"), F.when(k == 3, 2).otherwise(6).alias("mt"), F.when(k == 4, 10).otherwise(120).alias("tool"), ctx.alias("ctx"))
    return replay.replay_budgets(outputs, "ms", "mt", "tool", "ctx").select("id", "stop_reason", "stop_turn", "search_calls", "tokens", F.col("blocks").cast("long").alias("blocks"))


@query("p26_sequence_ratio")
def p26(spark, d):
    a, b = F.col("text"), F.regexp_replace("text", r"^\S+\s*", "")  # all of a text, and all but its first word
    return table(spark, d, "documents").select("doc_id", F.round(D.sequence_ratio(a, b), 6).alias("ratio"))


@query("f08_alias_matches")
def f08(spark, d):
    t = trajectories(spark, d).withColumn("final_answer", X.extract_answer(F.try_element_at("turns", F.lit(-1))["text"]))
    return D.alias_matches(t, "id")


@query("f17_source_priority", EXAMPLES_SQL + "SELECT origin, CAST(CASE origin WHEN 'dev' THEN 0 WHEN 'test' THEN 1 WHEN 'train' THEN 2 ELSE 3 END AS BIGINT) AS priority, count(*) AS n FROM ex GROUP BY origin")
def f17(spark, d):
    return examples(spark, d).groupBy("origin").agg(F.count("*").alias("n")).select("origin", prep.source_priority(F.col("origin")).cast("long").alias("priority"), "n")


@query("x11_prepared_splits", EXAMPLES_SQL + "SELECT origin, data_source, count(*) AS n FROM ex GROUP BY ALL")
def x11(spark, d):
    return examples(spark, d).groupBy("origin", "data_source").agg(F.count("*").alias("n"))


@query("k04_trajectory_report")
def k04(spark, d):
    t = M.group_advantages(trajectories(spark, d)).withColumn("ord", F.col("id"))
    return spark.createDataFrame([(k, x) for k, x in enumerate(reports.trajectory_report(t).split("\n"))], "line int, text string")


@query("k04_offline_report")
def k04o(spark, d):
    return spark.createDataFrame([(k, x) for k, x in enumerate(reports.offline_report(trajectories(spark, d)).split("\n"))], "line int, text string")


@query("k04_sensitivity_report")
def k04s(spark, d):
    return spark.createDataFrame([(k, x) for k, x in enumerate(reports.sensitivity_report(trajectories(spark, d), R.default_configs()).split("\n"))], "line int, text string")


@query("x_stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL")
def stream(spark, d):
    path = scratch(spark, "windows")
    windows.run_once(windows.windowed_stats(windows.read_events(spark, d)), path, scratch(spark, "stream"))
    return windows.latest(spark, path).withColumn("total", F.round("total", 4))


_AY = f""", ax AS (SELECT id, CASE WHEN valid_format AND NOT exact_match THEN 1 ELSE 0 END AS w, early, len(missing) > 0 AS mis, NOT exact_match AND search_calls > 0 AND NOT valid_format AND stop_reason IN ('max_search_calls', 'answer', 'invalid_format') AS guard FROM fz),
ay AS (SELECT ax.*, coalesce(h, 0) AS h, coalesce(e, 0) AS e, coalesce(f, 0) AS f FROM ax LEFT JOIN (SELECT id, count(*) FILTER ({Q._SHAPED}) AS h FROM su GROUP BY id) USING (id) LEFT JOIN (SELECT id, count(*) FILTER (bridge AND adds AND evidence) AS e, count(*) FILTER (bridge AND evidence AND len({Q._HOP}) > 0) AS f FROM sy GROUP BY id) USING (id))
"""
_A14 = _AY + """SELECT count(*) AS total, sum(w)::BIGINT AS wrong_valid, sum(h)::BIGINT AS helpful_turns, sum(h * w)::BIGINT AS credited_helpful_turns, sum(e)::BIGINT AS evidence_turns, sum(e * w)::BIGINT AS credited_evidence_turns, sum(f)::BIGINT AS final_hop_turns, sum(f * w)::BIGINT AS credited_final_hop_turns,
 count(*) FILTER (e > 0) AS evidence_records, count(*) FILTER (f > 0) AS final_hop_records, count(*) FILTER (w = 1 AND (e > 0 OR f > 0)) AS credited_records, count(*) FILTER (w = 1 AND early) AS early_penalty_records, count(*) FILTER (w = 1 AND mis) AS missing_penalty_records, count(*) FILTER (guard) AS guard_penalty_records FROM ay"""


_SECTIONS = {"evidence_candidates": "e > 0", "final_hop_candidates": "f > 0", "training_evidence_credits": "e * w > 0", "training_final_hop_credits": "f * w > 0", "early_answer_penalties": "w = 1 AND early", "missing_final_hop_penalties": "w = 1 AND mis", "final_answer_guard_penalties": "guard", "key_cases": "id IN (1, 7, 40)"}


@query("w09_credit_cases", Q.EVIDENCE_SQL + Q.FINAL_SQL + _AY + "SELECT section, id, CAST(row_number() OVER (PARTITION BY section ORDER BY id) AS INTEGER) AS rank FROM (SELECT id, unnest(list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _SECTIONS.items()) + "], lambda x: x IS NOT NULL)) AS section FROM ay) QUALIFY rank <= 12")
def w09c(spark, d):
    return credit.first_cases(credit.analyze(trajectories(spark, d)), 12, key_ids=(1, 7, 40)).select("section", "id", "rank")


@query("a14_credit_summary", Q.EVIDENCE_SQL + Q.FINAL_SQL + _A14)
def a14s(spark, d):
    return credit.summarize_analysis(credit.analyze(trajectories(spark, d)))


@query("a14_outcome_buckets", TRAJ_SQL + "SELECT data_source || '|exact=' || CASE WHEN exact_match THEN 'True' ELSE 'False' END || '|format=' || CASE WHEN valid_format THEN 'True' ELSE 'False' END || '|search_calls=' || search_calls AS bucket, count(*) AS n FROM tj GROUP BY 1")
def a14b(spark, d):
    return credit.outcome_buckets(credit.analyze(trajectories(spark, d)))


@query("p29_next_prompt", "SELECT item_id, CAST(length('<|user|>' || chr(10) || text || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || 'Look' || '<|end|>' || chr(10) || '<|tool|>' || chr(10) || 'seen' || '<|end|>' || chr(10) || '<|assistant|>' || chr(10)) AS BIGINT) AS n, true AS ends_open FROM benchmark")
def p29(spark, d):
    encode = prompts.encoder(prompts.code_points)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    user, said, seen = message("user", F.col("text")), message("assistant", F.lit("Look")), message("tool", F.lit("seen"))
    t = table(spark, d, "benchmark").select("item_id", encode(prompts.render(F.array(user), True)).alias("prompt"), encode(F.lit("Look")).alias("action"), encode(prompts.render(F.array(user, said), False)).alias("ended"), encode(prompts.render(F.array(user, said, seen), True)).alias("after"), encode(F.lit("Look<|e")).alias("completion"))
    got = t.select("item_id", prompts.next_prompt(F.col("prompt"), F.col("action"), F.col("ended"), F.col("after"), F.col("prompt"), F.col("completion")).alias("p"))
    return got.select("item_id", F.size("p.tokens").cast("long").alias("n"), (F.element_at("p.tokens", -1) == 10).alias("ends_open"))


@query("x03_backend_results", f"SELECT doc_id AS query_id, lang NOT IN ('en', 'de') AS empty FROM documents WHERE CAST('0x' || substr(md5('5:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 >= 0.3")
def x03(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("query"))
    pairs = spark.createDataFrame([("EN", 2), ("De ", 5)], "query string, n_items int")
    got = backends.build("mock", {"timeout": 0.1, "rate_limited": 0.2}, 5, pairs=pairs).search(asked)
    return got.where("ok").select("query_id", (F.col("n_items") == 0).alias("empty"))


@query("k04_credit_report")
def k04c(spark, d):
    return spark.createDataFrame([(k, x) for k, x in enumerate(reports.credit_report(trajectories(spark, d)).split("\n"))], "line int, text string")


@query("k04_targeted_report")
def k04t(spark, d):
    e = examples(spark, d)
    pick = lambda score: prep.select_candidates(e.withColumn("score", score["score"]), 60)
    bridge = pick(prep.bridge_score(F.col("question"), F.col("data_source")))
    alias = pick(prep.alias_score(F.col("question"), F.col("answers"))).join(bridge.select("data_source", "id"), ["data_source", "id"], "left_anti")
    return spark.createDataFrame([(k, x) for k, x in enumerate(reports.targeted_report(bridge, alias).split("\n"))], "line int, text string")
