"""Queries over trajectories: diagnostics, rewards, credit and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import turns as E
from ..operators import credit as C
from ..operators import diagnostics as D
from ..operators import metrics as M
from ..operators import rewards as R
from . import sqltext as S
from .derive import TRAJ_SQL, table, trajectories
from .registry import query

_Q = S.queries()
_TERMS = f"list_transform({_Q}, lambda q: {S.terms('q')})"
_HELPFUL = f"""len(list_filter(range(2, len(qs) + 1), lambda i: len(list_filter(tms[i], lambda t: NOT list_contains(flatten(tms[1:i - 1]), t))) >= 2
  AND ({S.has_any('tms[i]', X.FOLLOWUP_CUES)} OR len(list_filter(tms[i], lambda t: NOT list_contains(flatten(tms[1:i - 1]), t) AND NOT list_contains(qt, t))) > 0))) > 0"""

#: b0 holds the diagnosed trajectories.
BEHAVIOR_SQL = TRAJ_SQL + f""",
bq AS (SELECT *, {_Q} AS qs, {_TERMS} AS tms, {S.terms('question')} AS qt FROM tj),
ba AS (SELECT *, list_filter(list_transform(qs, lambda q: {S.squeeze('lower(q)')}), lambda q: q <> '') AS nq, search_calls > 0 AS searched,
  len(list_filter(turns, lambda t: t.role = 'tool')) AS tool_observation_count,
  len(list_filter(turns, lambda t: t.role = 'tool' AND t.items IS NOT NULL AND len(t.items) = 0 AND t.ok)) AS empty_observation_count,
  {_HELPFUL} AS helpful_followup_query FROM bq),
bb AS (SELECT *, len(nq) - len(list_distinct(nq)) AS duplicate_query_count, greatest(0, len(qs) - tool_observation_count) AS pending_tool_call_count,
  NOT searched AND exact_match AS direct_correct, searched AND exact_match AS searched_correct, searched AND valid_format AND NOT exact_match AS searched_wrong,
  NOT searched AND valid_format AND NOT exact_match AS direct_wrong, searched AND NOT valid_format AS searched_invalid_format,
  stop_reason = 'max_search_calls' AND NOT valid_format AS max_search_no_answer, search_calls >= 3 AND NOT exact_match AS too_many_search_no_gain FROM ba),
b0 AS (SELECT *, (max_search_no_answer OR too_many_search_no_gain) AND (duplicate_query_count > 0 OR NOT helpful_followup_query) AS bad_max_search_loop FROM bb)
"""
_FLAGS = ", ".join(D.BEHAVIOR)
_COUNTS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in D.COUNTS)


def counts(*names):
    return [F.col(c).cast("long").alias(c) for c in names]


def rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


@query("p17_tool_queries", TRAJ_SQL + f"SELECT id, array_to_string({_Q}, '|') AS queries FROM tj")
def p17(spark, d):
    return trajectories(spark, d).select("id", F.array_join(E.tool_queries(F.col("turns")), "|").alias("queries"))


@query("p18_final_text", TRAJ_SQL + "SELECT id, coalesce(list_filter(turns, lambda t: t.role = 'assistant' AND coalesce(t.parsed_kind, '') <> 'tool')[-1].text, '') AS answer_text, coalesce(list_filter(turns, lambda t: t.role = 'assistant')[-1].text, '') AS last_text FROM tj")
def p18(spark, d):
    return trajectories(spark, d).select("id", E.final_text(F.col("turns")).alias("answer_text"), E.final_text(F.col("turns"), any_kind=True).alias("last_text"))


@query("p19_observation_text", TRAJ_SQL + "SELECT id, array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'tool'), lambda t: coalesce(nullif(t.observation, ''), t.text, '')), ' ') AS observed FROM tj")
def p19(spark, d):
    return trajectories(spark, d).select("id", E.observation_text(F.col("turns")).alias("observed"))


@query("p20_event_text", TRAJ_SQL + f"SELECT id, md5(array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'tool'), lambda t: {S.event_text('t')}), '|')) AS said FROM tj")
def p20(spark, d):
    return trajectories(spark, d).select("id", F.md5(F.array_join(F.transform(E.tool_turns(F.col("turns")), E.event_text), "|")).alias("said"))


@query("f01_f02_observations", TRAJ_SQL + f"SELECT id, CAST(len(list_filter(turns, lambda t: t.role = 'tool' AND t.items IS NOT NULL AND len(t.items) = 0 AND t.ok)) AS BIGINT) AS empty, CAST(len(list_filter(turns, lambda t: {S.evidence('t')})) AS BIGINT) AS useful, CAST(len(list_filter(turns, lambda t: t.role = 'tool' AND NOT t.ok)) AS BIGINT) AS failed FROM tj")
def f01(spark, d):
    t = F.col("turns")
    return trajectories(spark, d).select("id", E.count_where(t, E.is_empty_observation).cast("long").alias("empty"), E.count_where(t, E.is_evidence).cast("long").alias("useful"), E.count_where(t, lambda x: E.is_true((x["role"] == "tool") & ~x["ok"])).cast("long").alias("failed"))


_SCORED = f"SELECT *, {S.answer('turns[-1].text')} AS ans FROM tj"
_EXACT = f"len(list_filter(answers, lambda r: {S.norm('r')} = {S.norm('ans')})) > 0"


@query("f03_score_answer", TRAJ_SQL + f", s AS ({_SCORED}) SELECT id, CASE WHEN ans IS NULL THEN -0.1 WHEN {_EXACT} THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, ans IS NOT NULL AS valid_format, ans IS NOT NULL AND coalesce({_EXACT}, false) AS exact_match FROM s")
def f03(spark, d):
    s = R.score_answer(F.coalesce(F.try_element_at("turns", F.lit(-1))["text"], F.lit("")), F.col("answers"))
    return trajectories(spark, d).select("id", s.alias("s")).select("id", "s.reward", "s.valid_format", "s.exact_match")


@query("f04_base_reward", "SELECT doc_id, CASE WHEN quality IS DISTINCT FROM 1 THEN -0.1 WHEN toxic = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM labels")
def f04(spark, d):
    return table(spark, d, "labels").select("doc_id", R.base_reward(F.col("quality") == 1, F.col("toxic") == 1).alias("reward"))


_YEARS = lambda c: f"list_distinct({S.matches(c, X.YEAR, 1)})"
_GRANULARITY = f"({S.norm('ans')} <> '' AND list_contains({_YEARS('ans')}, {S.norm('ans')}) AND len(list_filter(answers, lambda r: list_has_any({_YEARS('ans')}, {_YEARS('r')}) AND {S.norm('r')} <> {S.norm('ans')})) > 0)"
_MULTI_RE = r"(?i)(^|[^\p{L}\p{N}_])(or|或者|或)($|[^\p{L}\p{N}_])|/|;|\((?:[^)]*(^|[^\p{L}\p{N}_])(or|for)($|[^\p{L}\p{N}_])[^)]*)\)"
_MULTI = f"(regexp_matches(ans, '{_MULTI_RE}') AND NOT {_EXACT})"


@query("f05_granularity_miss", TRAJ_SQL + f", s AS ({_SCORED}) SELECT id, coalesce({_GRANULARITY}, false) AS miss FROM s")
def f05(spark, d):
    t = trajectories(spark, d).withColumn("a", X.extract_answer(F.try_element_at("turns", F.lit(-1))["text"]))
    return t.select("id", D.granularity_miss(F.col("a"), F.col("answers")).alias("miss"))


@query("f06_multi_candidate", TRAJ_SQL + f", s AS ({_SCORED}) SELECT id, coalesce({_MULTI}, false) AS multi FROM s")
def f06(spark, d):
    t = trajectories(spark, d).withColumn("a", X.extract_answer(F.try_element_at("turns", F.lit(-1))["text"]))
    return t.select("id", D.multi_candidate(F.col("a"), F.col("answers")).alias("multi"))


@query("f10_helpful_followup", BEHAVIOR_SQL + "SELECT id, helpful_followup_query FROM b0")
def f10(spark, d):
    return D.behavior(trajectories(spark, d)).select("id", "helpful_followup_query")


@query("f11_behavior", BEHAVIOR_SQL + f"SELECT id, {_FLAGS}, {_COUNTS} FROM b0")
def f11(spark, d):
    return D.behavior(trajectories(spark, d)).select("id", *D.BEHAVIOR, *counts(*D.COUNTS))


@query("f07_no_search_failure", BEHAVIOR_SQL + "SELECT id, NOT (direct_correct OR searched_correct OR searched_wrong OR searched_invalid_format) AND tool_observation_count = 0 AND pending_tool_call_count = 0 AS failure FROM b0")
def f07(spark, d):
    return D.behavior(trajectories(spark, d)).select("id", R.no_search_failure().alias("failure"))


@query("f12_offline_diagnostics")
def f12(spark, d):
    return D.offline(trajectories(spark, d)).select("id", "final_answer", *D.OFFLINE, F.array_join("reasons", "|").alias("reasons"))


_LABELS = {"correct": "exact_match", "wrong": "NOT exact_match AND valid_format", "invalid_format": "NOT exact_match AND NOT valid_format", "tool_failure": "len(list_filter(turns, lambda t: t.role = 'tool' AND NOT t.ok)) > 0", "repeated_search": "duplicate_query_count > 0", "empty_search": "empty_observation_count > 0"}
LABEL_SQL = BEHAVIOR_SQL + ", lb AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {_LABELS.get(c, c)} THEN '{c}' END" for c in D.LABELS) + "], lambda x: x IS NOT NULL) AS labels FROM b0)\n"


def labelled(spark, d):
    return D.labels(D.behavior(trajectories(spark, d)))


@query("f13_labels", LABEL_SQL + "SELECT id, array_to_string(labels, '|') AS labels FROM lb")
def f13(spark, d):
    return labelled(spark, d).select("id", F.array_join("labels", "|").alias("labels"))


@query("f14_cues", TRAJ_SQL + f"SELECT id, {S.cue('question', D.RELATION_CUES)} AS relation, {S.cue('question', C.EARLY_CUES)} AS early, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {S.cue('question', cues)} THEN '{a}' END" for a, cues in C.ATTRIBUTE_CUES.items()) + "], lambda x: x IS NOT NULL), '|') AS attributes FROM tj")
def f14(spark, d):
    q = F.col("question")
    return trajectories(spark, d).select("id", C.has_cue(q, D.RELATION_CUES).alias("relation"), C.has_cue(q, C.EARLY_CUES).alias("early"), F.array_join(C.required_attributes(q), "|").alias("attributes"))


@query("a01_summarize_behavior", BEHAVIOR_SQL + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in D.BEHAVIOR) + ", " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in D.COUNTS) + ", count(*) FILTER (empty_observation_count > 0) AS empty_search, count(*) FILTER (duplicate_query_count > 0) AS duplicate_query FROM b0")
def a01(spark, d):
    return D.summarize_behavior(D.behavior(trajectories(spark, d)))


_RATES = ["direct_correct", "searched_correct", "searched_wrong", "max_search_no_answer", "too_many_search_no_gain", "helpful_followup_query", "bad_max_search_loop"]


@query("a02_behavior_metrics", BEHAVIOR_SQL + "SELECT " + ", ".join(f"round(count(*) FILTER ({c}) / greatest(count(*), 1), 6) AS {c}_rate" for c in _RATES) + ", round(count(*) FILTER (duplicate_query_count > 0) / greatest(count(*), 1), 6) AS duplicate_query_rate, round(sum(empty_observation_count) / greatest(sum(tool_observation_count), 1), 6) AS empty_observation_rate FROM b0")
def a02(spark, d):
    m = D.behavior_metrics(D.behavior(trajectories(spark, d)))
    return rounded(m.select(*(F.col(f"`{c}`").alias(c.removeprefix("behavior/")) for c in m.columns)))


@query("a03_summarize_offline")
def a03(spark, d):
    return rounded(D.summarize_offline(D.offline(trajectories(spark, d))))


@query("a04_summarize_trajectories", LABEL_SQL + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (list_contains(labels, '{c}')) AS {c}" for c in D.LABELS[:5]) + ", round(avg(reward), 6) AS average_reward, round(sum(search_calls) / greatest(count(*), 1), 6) AS average_search_calls FROM lb")
def a04(spark, d):
    return rounded(D.summarize_trajectories(labelled(spark, d)))


@query("a05_label_counts", LABEL_SQL + f", fixed AS (SELECT unnest([{S.quoted(D.LABELS)}]) AS label, unnest(range({len(D.LABELS)})) AS ord) SELECT ord, fixed.label, count(x.label) AS n FROM fixed LEFT JOIN (SELECT unnest(labels) AS label FROM lb) x USING (label) GROUP BY ALL")
def a05(spark, d):
    return D.label_counts(labelled(spark, d)).withColumn("ord", F.col("ord").cast("long"))


@query("a06_evaluation_metrics", TRAJ_SQL + "SELECT round((SELECT avg(em) FROM (SELECT avg(exact_match::INT) AS em FROM tj GROUP BY data_source)), 6) AS em_macro, round(avg(exact_match::INT), 6) AS em_micro, round(avg(valid_format::INT), 6) AS format_rate, round(avg(search_calls), 6) AS search_calls, round(avg((search_calls = 0)::INT), 6) AS no_search_rate, round(avg(len(list_filter(turns, lambda t: t.role = 'assistant'))), 6) AS turns FROM tj")
def a06(spark, d):
    return rounded(M.evaluation_metrics(trajectories(spark, d)))


@query("a07_source_em", TRAJ_SQL + "SELECT data_source, round(avg(exact_match::INT), 6) AS em, count(*) AS n FROM tj GROUP BY data_source")
def a07(spark, d):
    return rounded(M.source_em(trajectories(spark, d)))


@query("a08_rollout_metrics", TRAJ_SQL + "SELECT round(avg(reward), 6) AS reward_mean, round(coalesce(avg(reward) FILTER (contains(data_source, 'nq')), 0), 6) AS reward_nq, round(coalesce(avg(reward) FILTER (contains(data_source, 'hotpotqa')), 0), 6) AS reward_hotpotqa, round(sum(search_calls) / greatest(sum(len(list_filter(turns, lambda t: t.role = 'assistant' AND t.query IS NOT NULL))), 1), 6) AS valid_tool_call_rate, round(avg((search_calls = 0)::INT), 6) AS no_search_rate FROM tj")
def a08(spark, d):
    return rounded(M.rollout_metrics(trajectories(spark, d)))


@query("a09_degenerate_groups", "SELECT count(*) AS n_groups, count(*) FILTER (lo = hi) AS degenerate FROM (SELECT min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id)")
def a09(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("question_index"), F.col("value").alias("reward"))
    return M.degenerate_groups(M.group_advantages(e))


@query("a14_turn_outcomes", BEHAVIOR_SQL + "SELECT data_source, exact_match, valid_format, CAST(search_calls AS BIGINT) AS search_calls, count(*) AS n, count(*) FILTER (helpful_followup_query) AS helpful FROM b0 GROUP BY ALL")
def a14(spark, d):
    return D.behavior(trajectories(spark, d)).groupBy("data_source", "exact_match", "valid_format", F.col("search_calls").cast("long").alias("search_calls")).agg(F.count("*").alias("n"), F.count_if("helpful_followup_query").alias("helpful"))


@query("a19_tool_failures", TRAJ_SQL + "SELECT id, CAST(len(list_filter(turns, lambda t: t.role = 'tool' AND NOT t.ok)) AS BIGINT) AS tool_failures FROM tj")
def a19(spark, d):
    return trajectories(spark, d).select("id", E.count_where(F.col("turns"), lambda t: E.is_true((t["role"] == "tool") & ~t["ok"])).cast("long").alias("tool_failures"))


@query("j06_next_observation", TRAJ_SQL + """, e AS (SELECT id, unnest(turns) AS t, generate_subscripts(turns, 1) AS i FROM tj),
n AS (SELECT id, i, t, lead(t) OVER (PARTITION BY id ORDER BY i) AS nx, sum((t.role = 'assistant')::INT) OVER (PARTITION BY id ORDER BY i) - 1 AS turn_index FROM e)
SELECT id, CAST(turn_index AS BIGINT) AS turn_index, t.query AS query, CASE WHEN nx.role = 'tool' THEN nx.observation END AS observation FROM n WHERE t.role = 'assistant' AND t.query IS NOT NULL""")
def j06(spark, d):
    return C.found_rows(trajectories(spark, d)).select("id", F.col("turn_index").cast("long").alias("turn_index"), "query", "observation")


#: st holds the search turns with what came before them.
SEARCH_SQL = TRAJ_SQL + f""", e AS (SELECT id, question, answers, valid_format, exact_match, unnest(turns) AS t, generate_subscripts(turns, 1) AS i FROM tj),
nx AS (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY i) AS follows, sum((t.role = 'assistant')::INT) OVER (PARTITION BY id ORDER BY i) - 1 AS turn_index FROM e),
sq AS (SELECT id, question, answers, valid_format, exact_match, i, turn_index, t.query AS query, {S.squeeze('lower(t.query)')} AS norm, {S.terms('t.query')} AS terms, CASE WHEN follows.role = 'tool' THEN follows END AS seen_now FROM nx WHERE t.role = 'assistant' AND t.query IS NOT NULL),
st AS (SELECT *, lag(seen_now) OVER w AS seen_before, list_distinct(coalesce(list(norm) OVER p, [])) AS asked, list_distinct(flatten(coalesce(list(terms) OVER p, []))) AS old_terms FROM sq
  WINDOW w AS (PARTITION BY id ORDER BY i), p AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
su AS (SELECT *, len(list_filter(asked, lambda a: a <> '')) >= 1 AND NOT list_contains(asked, norm) AS later, list_filter(terms, lambda t: NOT list_contains(old_terms, t)) AS new, {S.terms('question')} AS qt FROM st)
"""


@query("d07_helpful_bridge", SEARCH_SQL + f"SELECT id, CAST(turn_index AS BIGINT) AS turn_index FROM su WHERE later AND len(new) >= 2 AND ({S.has_any('terms', X.FOLLOWUP_CUES)} OR len(list_filter(new, lambda t: NOT list_contains(qt, t))) > 0) AND {S.evidence('seen_before')}")
def d07(spark, d):
    return C.found_rows(trajectories(spark, d)).where("helpful").select("id", F.col("turn_index").cast("long").alias("turn_index"))


_SUBSET = lambda a, b: f"len(list_filter({a}, lambda z: NOT list_contains({b}, z))) = 0"
_BRIDGE = f"""(len(list_filter(list_concat({S.spans(S.event_text('seen_before'))}, list_filter(list_transform(coalesce(seen_before.items, []), lambda itm: itm.title), lambda ttl: ttl <> '')),
  lambda s: len({S.terms('s')}) > 0 AND ({_SUBSET(S.terms('s'), 'terms')} OR len(list_filter({S.terms('s')}, lambda z: list_contains(terms, z) AND length(z) >= 6)) > 0))) > 0
  OR len(list_filter({S.spans('question')}, lambda s: len({S.terms('s')}) > 0 AND {_SUBSET(S.terms('s'), 'terms')})) > 0)"""
_NOW = S.event_text("seen_now")
EVIDENCE_SQL = SEARCH_SQL + f""", sv AS (SELECT *, {_NOW} AS body FROM su WHERE later AND {S.evidence('seen_before')} AND {S.evidence('seen_now')}),
sx AS (SELECT *, {S.terms('body')} AS own, string_split({S.norm('body')}, ' ') AS toks, {_BRIDGE} AS bridge FROM sv),
sy AS (SELECT *, len(list_filter(answers, lambda a: len({S.answer_terms('a')}) > 0 AND {_SUBSET(S.answer_terms('a'), 'toks')})) > 0
   OR (list_has_any(terms, own) AND {S.has_any('own', C.RELATION_TOKENS)})
   OR (len(list_intersect(terms, own)) >= 2 AND (regexp_matches(body, '{X.NUMBER}') OR len({S.spans('body')}) > 0)) AS evidence,
   {S.has_any('terms', C.RELATION_TOKENS)} OR len(list_filter(new, lambda t: NOT list_contains(qt, t))) > 0 AS adds FROM sx)
"""


@query("d08_evidence_bridge", EVIDENCE_SQL + "SELECT id, CAST(turn_index AS BIGINT) AS turn_index FROM sy WHERE bridge AND adds AND evidence")
def d08(spark, d):
    return C.found_rows(trajectories(spark, d)).where("evidence").select("id", F.col("turn_index").cast("long").alias("turn_index"))


_HOP = "list_filter([" + ", ".join(f"CASE WHEN {S.cue('question', C.ATTRIBUTE_CUES[a])} AND ({S.has_any('terms', t)} OR {S.has_any('own', t)}" + (f" OR regexp_matches(body, '{X.NUMBER}')" if a == "date" else "") + f") THEN '{a}' END" for a, t in C.ATTRIBUTE_TERMS.items()) + "], lambda x: x IS NOT NULL)"


@query("d09_final_hop", EVIDENCE_SQL + f"SELECT id, CAST(turn_index AS BIGINT) AS turn_index, array_to_string({_HOP}, '|') AS attributes FROM sy WHERE bridge AND evidence AND len({_HOP}) > 0")
def d09(spark, d):
    return C.found_rows(trajectories(spark, d)).where(F.size("hop") > 0).select("id", F.col("turn_index").cast("long").alias("turn_index"), F.array_join("hop", "|").alias("attributes"))


_EARLY_TEXT = f"question || ' ' || array_to_string({_Q}, ' ') || ' ' || {S.event_text('ft')} || ' ' || coalesce(ans, '')"


@query("d13_early_answer_risk", TRAJ_SQL + f", s AS (SELECT *, list_filter(turns, lambda t: t.role = 'tool')[1] AS ft, {S.answer('turns[-1].text')} AS ans FROM tj), x AS (SELECT *, {_EARLY_TEXT} AS everything FROM s) SELECT id, coalesce(search_calls <= 1 AND stop_reason = 'answer' AND {S.cue('question', C.EARLY_CUES)} AND {S.evidence('ft')} AND len({S.spans('everything')}) + len(list_distinct({S.matches('everything', X.NUMBER)})) >= 3, false) AS risky FROM x")
def d13(spark, d):
    t = trajectories(spark, d).withColumn("queries", E.tool_queries(F.col("turns")))
    return t.select("id", C.early_answer_risk(X.extract_answer(F.try_element_at("turns", F.lit(-1))["text"])).alias("risky"))


_COVERS = {a: S.has_any("qterms", t) for a, t in C.ATTRIBUTE_TERMS.items()}
_COVERS["date"] = f"({S.has_any('qterms', ['date', 'year'])} OR ({S.cue('question', ['birth', 'born', 'older', 'younger'])} AND {S.has_any('qterms', ['birth', 'birthdate', 'born'])}) OR ({S.cue('question', ['death', 'die', 'died', 'died earlier'])} AND {S.has_any('qterms', ['death', 'deathdate', 'die', 'died'])}))"
_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {S.cue('question', C.ATTRIBUTE_CUES[a])} AND NOT {_COVERS[a]} THEN '{a}' END" for a in C.ATTRIBUTE_TERMS) + "], lambda x: x IS NOT NULL)"
_SAYS = "(" + " OR ".join(f"({S.cue('question', C.ATTRIBUTE_CUES[a])} AND ({S.has_any('ev.own', t)}" + (f" OR regexp_matches(ev.body, '{X.NUMBER}')" if a == "date" else "") + "))" for a, t in C.ATTRIBUTE_TERMS.items()) + ")"

#: fz holds the trajectories with what their final answers risk.
FINAL_SQL = f""", fa AS (SELECT *, list_filter(turns, lambda t: t.role = 'assistant') AS assist, list_filter(turns, lambda t: t.role = 'tool') AS tools FROM tj),
fb AS (SELECT *, coalesce(list_max(list_filter(range(len(assist)), lambda n: assist[n + 1].query IS NULL)), len(assist) - 1) AS final_index, tools[1] AS ft, {S.answer('assist[-1].text')} AS ans, {S.terms(f"array_to_string({_Q}, ' ')")} AS qterms FROM fa),
fc AS (SELECT *, list_transform(tools, lambda tt: {{'body': {S.event_text('tt')}, 'own': {S.terms(S.event_text('tt'))}}}) AS events, {S.answer_terms('ans')} AS own, {_EARLY_TEXT} AS everything FROM fb),
fz AS (SELECT *, coalesce(search_calls <= 1 AND stop_reason = 'answer' AND {S.cue('question', C.EARLY_CUES)} AND {S.evidence('ft')} AND len({S.spans('everything')}) + len(list_distinct({S.matches('everything', X.NUMBER)})) >= 3, false) AS early,
  CASE WHEN search_calls > 0 AND stop_reason = 'answer' AND len(list_filter(turns, lambda tt: {S.evidence('tt')})) > 0 AND NOT (len(own) > 0 AND len(list_filter(events, lambda ev: {_SUBSET('own', 'ev.own')} AND {_SAYS})) > 0) THEN {_MISSING} ELSE [] END AS missing FROM fc)
"""


@query("d14_missing_final_hop", TRAJ_SQL + FINAL_SQL + "SELECT id, array_to_string(missing, '|') AS missing FROM fz")
def d14(spark, d):
    t = trajectories(spark, d).withColumn("queries", E.tool_queries(F.col("turns")))
    return t.select("id", F.array_join(C.missing_attributes(X.extract_answer(E.final_text(F.col("turns"), any_kind=True))), "|").alias("missing"))


@query("d15_answer_guard", TRAJ_SQL + "SELECT id, CASE WHEN NOT exact_match AND search_calls > 0 AND NOT valid_format THEN CASE WHEN stop_reason = 'max_search_calls' THEN 'max_search_no_answer_after_search' WHEN stop_reason IN ('answer', 'invalid_format') THEN 'invalid_final_answer_format_after_search' END END AS reason FROM tj")
def d15(spark, d):
    return trajectories(spark, d).select("id", C.guard_reason().alias("reason"))


CREDIT = C.Credit("final_hop_bridge", evidence_bonus=0.05, final_hop_bonus=0.08, early_penalty=0.05, missing_penalty=0.08, guard_penalty=0.06)


#: cl holds the labels of CREDIT.
CREDIT_SQL = EVIDENCE_SQL + FINAL_SQL + f""", ga AS (SELECT id, CASE WHEN min(reward) OVER g = max(reward) OVER g THEN 0 ELSE reward - avg(reward) OVER g END AS adv FROM tj WINDOW g AS (PARTITION BY question_index)),
al AS (SELECT id, final_index AS turn_index, 'final_answer_guard' AS label, NULL AS query, -0.06 AS bonus, 1 AS prio FROM fz WHERE NOT exact_match AND search_calls > 0 AND NOT valid_format AND stop_reason IN ('max_search_calls', 'answer', 'invalid_format')
  UNION ALL SELECT id, turn_index, 'evidence_bridge_search', query, 0.05, 2 FROM sy WHERE valid_format AND NOT exact_match AND bridge AND adds AND evidence
  UNION ALL SELECT id, turn_index, 'final_hop_attribute_search', query, 0.08, 3 FROM sy WHERE valid_format AND NOT exact_match AND bridge AND evidence AND len({_HOP}) > 0
  UNION ALL SELECT id, final_index, 'early_answer_missing_followup', NULL, -0.05, 4 FROM fz WHERE valid_format AND NOT exact_match AND early
  UNION ALL SELECT id, final_index, 'missing_final_hop_attribute', NULL, -0.08, 5 FROM fz WHERE valid_format AND NOT exact_match AND len(missing) > 0),
cl AS (SELECT al.id, CAST(turn_index AS BIGINT) AS turn_index, label, query, CAST(bonus AS DOUBLE) AS bonus, round(CASE WHEN bonus >= 0 THEN greatest(adv, 0) + bonus ELSE least(adv, 0) + bonus END, 6)::DOUBLE AS effective_advantage FROM al JOIN ga USING (id) QUALIFY row_number() OVER (PARTITION BY al.id, turn_index ORDER BY prio DESC) = 1)
"""


@query("d16_credit_labels", CREDIT_SQL + "SELECT * FROM cl")
def d16(spark, d):
    t = M.group_advantages(trajectories(spark, d))
    return C.credit_rows(t, CREDIT).select("id", F.col("turn_index").cast("long").alias("turn_index"), "label", "query", "bonus", F.round("effective_advantage", 6).alias("effective_advantage"))


@query("d16_helpful_credit", SEARCH_SQL + f", ga AS (SELECT id, CASE WHEN min(reward) OVER g = max(reward) OVER g THEN 0 ELSE reward - avg(reward) OVER g END AS adv FROM tj WINDOW g AS (PARTITION BY question_index)) SELECT id, CAST(turn_index AS BIGINT) AS turn_index, query, round(greatest(adv, 0) + 0.1, 6) AS effective_advantage FROM su JOIN ga USING (id) WHERE valid_format AND NOT exact_match AND later AND len(new) >= 2 AND ({S.has_any('terms', X.FOLLOWUP_CUES)} OR len(list_filter(new, lambda t: NOT list_contains(qt, t))) > 0) AND {S.evidence('seen_before')}")
def d16h(spark, d):
    t = M.group_advantages(trajectories(spark, d))
    return C.credit_rows(t, C.Credit("helpful_bridge", helpful_bonus=0.1)).select("id", F.col("turn_index").cast("long").alias("turn_index"), "query", F.round("effective_advantage", 6).alias("effective_advantage"))


@query("d17_final_turn_index", TRAJ_SQL + "SELECT id, CAST(coalesce(list_max(list_filter(range(len(a)), lambda i: a[i + 1].query IS NULL)), len(a) - 1) AS BIGINT) AS turn_index FROM (SELECT id, list_filter(turns, lambda t: t.role = 'assistant') AS a FROM tj)")
def d17(spark, d):
    return trajectories(spark, d).select("id", C.final_turn_index().cast("long").alias("turn_index"))


_SHAPED = f"later AND len(new) >= 2 AND ({S.has_any('terms', X.FOLLOWUP_CUES)} OR len(list_filter(new, lambda t: NOT list_contains(qt, t))) > 0) AND {S.evidence('seen_before')}"


@query("d18_credit_analysis", EVIDENCE_SQL + f"SELECT su.id, count(*) FILTER ({_SHAPED}) AS helpful_turns, coalesce(any_value(ev), 0)::BIGINT AS evidence_turns, coalesce(any_value(hop), 0)::BIGINT AS final_hop_turns FROM su LEFT JOIN (SELECT id, count(*) FILTER (bridge AND adds AND evidence) AS ev, count(*) FILTER (bridge AND evidence AND len({_HOP}) > 0) AS hop FROM sy GROUP BY id) y ON y.id = su.id GROUP BY su.id")
def d18(spark, d):
    return C.analyze(trajectories(spark, d)).where(F.col("found_turns") > 0).select("id", "helpful_turns", "evidence_turns", "final_hop_turns")


@query("a10_credit_metrics", CREDIT_SQL + "SELECT label, count(*) AS turns, count(DISTINCT id) AS trajectories FROM cl GROUP BY label")
def a10(spark, d):
    got = C.credit_labels(M.group_advantages(trajectories(spark, d)), CREDIT)
    return got.groupBy("label").agg(F.count("*").alias("turns"), F.count_distinct("id").alias("trajectories"))


@query("d05_rescore")
def d05(spark, d):
    return rounded(R.rescore(trajectories(spark, d), R.default_configs()))


#: rs holds every trajectory under every default configuration; the alias label, which needs a similarity ratio, is left out.
_W = {name: R.default_configs()[name] for name in R.DEFAULT_CONFIGS}
_CONF = "cf(config_ord, config_name, dup, emp, maxs, verb, thr, bad, dat, mul, bon, nos) AS (VALUES " + ", ".join(f"({k}, '{n}', {c.duplicate_query_penalty}, {c.empty_result_penalty}, {c.max_search_no_answer_penalty}, {c.verbose_answer_penalty}, {c.verbose_answer_token_threshold}, {c.bad_max_search_penalty}, {c.date_granularity_penalty}, {c.multi_candidate_answer_penalty}, {c.helpful_followup_bonus}, {c.no_search_penalty})" for k, (n, c) in enumerate(_W.items())) + ")"
RESCORE_SQL = BEHAVIOR_SQL + f""", {_CONF},
ra AS (SELECT *, coalesce(list_filter(turns, lambda t: t.role = 'assistant' AND coalesce(t.parsed_kind, '') <> 'tool')[-1].text, '') AS ft FROM b0),
rb AS (SELECT *, {S.answer('ft')} AS ans FROM ra),
rc AS (SELECT *, CASE WHEN NOT valid_format THEN -0.1 WHEN exact_match THEN 1.0 ELSE 0.0 END AS base, valid_format AND exact_match AS ok, coalesce({_GRANULARITY}, false) AS g, coalesce({_MULTI}, false) AS m,
  NOT (direct_correct OR searched_correct OR searched_wrong OR searched_invalid_format) AND tool_observation_count = 0 AND pending_tool_call_count = 0 AS nosearch, CASE WHEN ans IS NULL THEN 0 ELSE len({S.words('ans')}) END AS nw FROM rb),
rd AS (SELECT *, CASE WHEN ok THEN 0 ELSE 1 END AS z FROM rc CROSS JOIN cf),
rs AS (SELECT *, z * (CASE WHEN helpful_followup_query AND valid_format AND NOT bad_max_search_loop THEN bon ELSE 0 END - CASE WHEN duplicate_query_count > 0 THEN dup ELSE 0 END - CASE WHEN empty_observation_count > 0 THEN emp ELSE 0 END
  - CASE WHEN max_search_no_answer THEN maxs ELSE 0 END - CASE WHEN ans IS NOT NULL AND verb > 0 AND thr > 0 AND nw > thr THEN verb ELSE 0 END - CASE WHEN bad_max_search_loop THEN bad ELSE 0 END - CASE WHEN g THEN dat ELSE 0 END - CASE WHEN m THEN mul ELSE 0 END - CASE WHEN nosearch THEN nos ELSE 0 END) AS delta FROM rd)
"""


#: rd's rows with what offline diagnostics say of them; the alias label, which needs a similarity ratio, is left out.
_SEEN = "array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'tool'), lambda t: coalesce(nullif(t.observation, ''), t.text, '')), ' ')"
_EVERYTHING = f"concat_ws(' ', question, array_to_string({_Q}, ' '), {_SEEN}, ans)"
OFFLINE_SQL = RESCORE_SQL + f""", oa AS (SELECT *, valid_format AND NOT exact_match AND ans IS NOT NULL AS gate, {_SEEN} AS seen, {_EVERYTHING} AS everything FROM rc),
ob AS (SELECT *, gate AND g AS answer_granularity_miss, gate AND m AS multi_candidate_answer, gate AND search_calls = 1 AND {S.cue('question', D.RELATION_CUES)} AND seen <> '' AND len(list_distinct({S.matches('everything', X.NAMED_ENTITY)})) >= 3 AS missing_followup_query FROM oa)
"""
_OFFLINE = [c for c in D.OFFLINE if c != "possible_alias_match"]


@query("f12_offline_labels", OFFLINE_SQL + f"SELECT id, ans AS final_answer, {', '.join(_OFFLINE)} FROM ob")
def f12l(spark, d):
    """All labels of offline diagnostics but the one that needs a similarity ratio."""
    return D.offline(trajectories(spark, d)).select("id", "final_answer", *_OFFLINE)


@query("a03_offline_rates", OFFLINE_SQL + "SELECT count(*) AS total, count(*) FILTER (valid_format AND NOT exact_match) AS wrong_valid, " + ", ".join(f"count(*) FILTER ({c}) AS {c}, round(count(*) FILTER ({c}) / greatest(count(*), 1), 6) AS {c}_rate" for c in _OFFLINE) + ", " + ", ".join(f"round(count(*) FILTER ({c}) / greatest(count(*) FILTER (valid_format AND NOT exact_match), 1), 6) AS {c}_wrong_valid_rate" for c in ("answer_granularity_miss", "missing_followup_query", "multi_candidate_answer")) + " FROM ob")
def a03r(spark, d):
    s = D.summarize_offline(D.offline(trajectories(spark, d)))
    return rounded(s.select([c for c in s.columns if not c.startswith("possible_alias_match")]))


_PAID = {"duplicate_query_penalty": ("duplicate_query_count > 0", "dup"), "empty_result_penalty": ("empty_observation_count > 0", "emp"), "max_search_no_answer_penalty": ("max_search_no_answer", "maxs"), "verbose_answer_penalty": ("ans IS NOT NULL AND thr > 0 AND nw > thr", "verb"), "bad_max_search_penalty": ("bad_max_search_loop", "bad"), "date_granularity_penalty": ("g", "dat"), "multi_candidate_answer_penalty": ("m", "mul"), "no_search_penalty": ("nosearch", "nos"), "helpful_followup_bonus": ("helpful_followup_query AND valid_format AND NOT bad_max_search_loop", "bon")}
_TERMS_SQL = "round(base::DOUBLE, 6) AS base_reward, round((base + delta)::DOUBLE, 6) AS final_reward, round(delta::DOUBLE, 6) AS reward_delta, " + ", ".join(f"round((z * CASE WHEN {rule} THEN {weight} ELSE 0 END)::DOUBLE, 6) AS {c}" for c, (rule, weight) in _PAID.items())


@query("d05_rescored_terms", RESCORE_SQL + f"SELECT config_name, id, ans AS final_answer, ok AS exact_match, {_TERMS_SQL} FROM rs")
def d05t(spark, d):
    """Every penalty and bonus of every trajectory under every configuration."""
    return rounded(R.rescore(trajectories(spark, d), R.default_configs()).select("config_name", "id", "final_answer", "exact_match", "base_reward", "final_reward", "reward_delta", *_PAID))


#: The same for trajectories whose flags are those of their last assistant text.
ONLINE_SQL = TRAJ_SQL + f""", tx AS (SELECT *, {S.answer("coalesce(list_filter(turns, lambda t: t.role = 'assistant')[-1].text, '')")} AS ans FROM tj),
ty AS (SELECT * REPLACE (ans IS NOT NULL AS valid_format, ans IS NOT NULL AND coalesce({_EXACT}, false) AS exact_match) FROM tx), tk AS (SELECT * EXCLUDE (ans) FROM ty)
""" + RESCORE_SQL.removeprefix(TRAJ_SQL).replace("FROM tj)", "FROM tk)")


@query("d06_online_terms", ONLINE_SQL + f"SELECT id, {_TERMS_SQL} FROM rs WHERE config_name = 'reward_v4_followup_bonus'")
def d06t(spark, d):
    got = R.score_trajectories(trajectories(spark, d), R.default_configs()["reward_v4_followup_bonus"])
    return rounded(got.select("id", "base_reward", "final_reward", "reward_delta", *_PAID))


@query("d02_shaped_rewards", RESCORE_SQL + "SELECT config_name, id, round(base::DOUBLE, 6) AS base_reward, round((base + delta)::DOUBLE, 6) AS final_reward FROM rs")
def d02(spark, d):
    return rounded(R.rescore(trajectories(spark, d), R.default_configs()).select("config_name", "id", "base_reward", "final_reward"))


@query("a13_sensitivity_summary", RESCORE_SQL + "SELECT config_name, count(*) AS total, round(avg(base)::DOUBLE, 6) AS mean_base_reward, round(avg(base + delta)::DOUBLE, 6) AS mean_final_reward, count(*) FILTER (delta < -1e-9) AS penalized_count, count(*) FILTER (delta < -1e-9 AND ok) AS correct_penalized_count, count(*) FILTER (delta < -1e-9 AND valid_format AND NOT exact_match) AS wrong_valid_penalized_count, count(*) FILTER (delta < -1e-9 AND helpful_followup_query) AS helpful_followup_penalized_count, count(*) FILTER (delta > 1e-9) AS boosted_count FROM rs GROUP BY config_name")
def a13(spark, d):
    s = R.summarize(R.rescore(trajectories(spark, d), R.default_configs()))
    return rounded(s.select("config_name", "total", "mean_base_reward", "mean_final_reward", "penalized_count", "correct_penalized_count", "wrong_valid_penalized_count", "helpful_followup_penalized_count", "boosted_count"))


@query("w08_top_penalties", RESCORE_SQL + "SELECT config_name, row_number() OVER (PARTITION BY config_name ORDER BY round(delta, 9), id) AS rank, id, round(delta::DOUBLE, 6) AS reward_delta FROM rs WHERE delta < -1e-9 QUALIFY rank <= 5")
def w08(spark, d):
    r = R.rescore(trajectories(spark, d), R.default_configs()).where("reward_delta < 0")
    return rounded(M.first_of_each(r, ["config_name"], 5, F.round("reward_delta", 9), "id").select("config_name", F.col("rank").cast("long").alias("rank"), "id", "reward_delta"))


@query("d03_default_configs", f"WITH {_CONF} SELECT config_name, dup::DOUBLE AS duplicate_query_penalty, bon::DOUBLE AS helpful_followup_bonus, nos::DOUBLE AS no_search_penalty FROM cf")
def d03(spark, d):
    return R.config_table(spark, R.default_configs()).select("config_name", "duplicate_query_penalty", "helpful_followup_bonus", "no_search_penalty")


@query("d06_score_online")
def d06(spark, d):
    return rounded(R.score_trajectories(trajectories(spark, d), R.default_configs()["reward_v4_followup_bonus"]).select("id", "base_reward", "final_reward"))


@query("d32_record_schema", TRAJ_SQL + "SELECT id, data_source, CAST(len(list_filter(turns, lambda t: t.role = 'assistant')) AS BIGINT) AS assistant_turns, CAST(len(turns) AS BIGINT) AS n_turns, stop_reason FROM tj")
def d32(spark, d):
    return trajectories(spark, d).select("id", "data_source", E.count_where(F.col("turns"), lambda t: t["role"] == "assistant").cast("long").alias("assistant_turns"), F.size("turns").cast("long").alias("n_turns"), "stop_reason")


@query("j09_gained_lost", "SELECT count(*) FILTER (quality = 1 AND toxic <> 1) AS gained, count(*) FILTER (toxic = 1 AND quality <> 1) AS lost, count(*) AS n FROM labels")
def j09(spark, d):
    t = table(spark, d, "labels")
    return M.gained_lost(t.select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("exact_match")), t.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("exact_match")))


@query("j10_patched_runs", TRAJ_SQL + "SELECT id, CASE WHEN stop_reason = 'answer' THEN reward ELSE 0.5 END::DOUBLE AS reward, stop_reason <> 'answer' AS patched FROM tj")
def j10(spark, d):
    t = trajectories(spark, d).select("id", "reward", "stop_reason")
    return M.patch(t, t.where("stop_reason <> 'answer'").withColumn("reward", F.lit(0.5))).select("id", "reward", "patched")


@query("w07_group_comparison", "WITH g AS (SELECT user_id, event_id, CASE WHEN min(value) OVER w = max(value) OVER w THEN 0 ELSE value - avg(value) OVER w END AS adv, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id)) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY adv DESC, event_id) AS rank FROM g WHERE n > 1")
def w07(spark, d):
    e = M.group_advantages(table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("reward")), "user_id")
    return M.group_comparison(e, "user_id", "event_id").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("w09_first_cases", LABEL_SQL + ", x AS (SELECT id, unnest(labels) AS label FROM lb) SELECT label, id FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 3")
def w09(spark, d):
    each = labelled(spark, d).select("id", F.explode("labels").alias("label"))
    return M.first_of_each(each, ["label"], 3, "id").select("label", "id")


@query("w10_best_checkpoint", "SELECT arg_min(source, (-em, source)) AS best FROM (SELECT source, avg((doc_id % 3 = 0)::INT) AS em FROM documents GROUP BY source)")
def w10(spark, d):
    em = table(spark, d, "documents").groupBy("source").agg(F.avg((F.col("doc_id") % 3 == 0).cast("int")).alias("em"))
    return em.agg(F.min_by("source", F.struct(-F.col("em"), "source")).alias("best"))
