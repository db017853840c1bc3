"""Turn-level credit: which search turns helped, which answers came too early, and what a turn's advantage becomes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import turns as E

# Tokens and cues of the detectors.
RELATION_TOKENS = [*X.FOLLOWUP_CUES, "alias", "american", "attend", "attended", "filmmaker", "known", "length", "league", "name", "named", "national", "nationality", "parent", "parents", "system", "university"]
ATTRIBUTE_CUES = {
    "creative_role": ["author", "composer", "director", "producer", "writer"],
    "date": ["birth", "born", "birthdate", "date", "death", "deathdate", "die", "died", "died earlier", "older", "younger", "year"],
    "family": ["father", "grandfather", "grandmother", "husband", "maternal", "mother", "parent", "parents", "paternal", "spouse", "wife"],
    "founder": ["founded", "founder"],
    "nationality": ["birthplace", "born in", "country", "national", "nationality"],
}
ATTRIBUTE_TERMS = {
    "creative_role": ["author", "composer", "director", "producer", "writer"],
    "date": ["birth", "birthdate", "born", "date", "death", "deathdate", "died", "year"],
    "family": ["father", "grandfather", "grandmother", "husband", "maternal", "mother", "parent", "parents", "paternal", "spouse", "wife"],
    "founder": ["founded", "founder", "organization", "company"],
    "nationality": ["birthplace", "born", "country", "national", "nationality"],
}
EARLY_CUES = ["also known as", "director", "father", "founder", "grandfather", "grandmother", "husband", "known as", "length", "how many", "km", "long", "maternal", "mother", "parent", "parents", "paternal", "studied", "university", "wife", "writer"]
#: Later labels overwrite earlier ones of the same turn.
PRECEDENCE = ["helpful_bridge_search", "final_answer_guard", "evidence_bridge_search", "final_hop_attribute_search", "early_answer_missing_followup", "missing_final_hop_attribute"]


def has_cue(c: Column, cues: list[str]) -> Column:
    """Whether the lower-cased text holds a cue; one pattern, as a loop over cues would lower the text for each."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(map(re.escape, cues)))


def required_attributes(question: Column) -> Column:
    """sorted attributes that a question asks for."""
    return F.array_compact(F.array(*(F.when(has_cue(question, cues), F.lit(a)) for a, cues in ATTRIBUTE_CUES.items())))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: lambdas share no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _turn_features(turns: Column) -> Column:
    """What the detectors need of each turn, each text read once: a search's query and terms, an evidence turn's body, terms and spans."""

    def texts(t):
        asks = (t["role"] == "assistant") & t["tool_call"]["query"].isNotNull()
        titles = F.filter(F.transform(t["items"], lambda i: i["title"]), lambda x: x.isNotNull() & (x != ""))
        return F.struct(t["role"].alias("role"), F.when(asks, t["tool_call"]["query"]).alias("query"), F.when(t["role"] == "tool", t["observation"]).alias("observation"), E.is_evidence(t).alias("evidence"), F.when(E.is_evidence(t), E.event_text(t)).alias("body"), F.when(E.is_evidence(t), titles).alias("titles"))

    def parts(t):
        own = F.when(t["query"].isNotNull(), X.query_terms(t["query"])).otherwise(X.query_terms(t["body"]))
        spans = F.when(t["evidence"], F.array_union(X.entity_spans(t["body"]), t["titles"]))
        entities = F.when(t["evidence"], F.size(X.entity_spans(t["body"])) > 0)
        words = F.when(t["evidence"], F.split(X.normalize_answer(t["body"]), " "))
        return F.struct(t["role"].alias("role"), t["query"].alias("query"), X.normalize_query(t["query"]).alias("norm"), own.alias("terms"), t["observation"].alias("observation"), t["evidence"].alias("evidence"), t["body"].rlike(X.NUMBER).alias("number"), entities.alias("entities"), words.alias("words"), F.transform(spans, X.query_terms).alias("spans"))

    return F.transform(F.transform(turns, texts), parts)


def _question_features() -> Column:
    """An array of one struct, so that it is computed once a trajectory and not folded into lambdas."""
    return F.transform(F.array("question"), lambda q: F.struct(X.query_terms(q).alias("terms"), F.transform(X.entity_spans(q), X.query_terms).alias("spans"), required_attributes(q).alias("wanted"), F.transform("answers", X.answer_terms).alias("answers")))


def names_all(own: Column, terms: Column) -> Column:
    return (F.size(own) > 0) & X.subset(own, terms)


def is_later(norm: Column, asked: Column) -> Column:
    """A second or later query that is no repetition."""
    return (F.size(asked) >= 1) & ~F.array_contains(asked, norm)


def helpful_bridge(x: Column, new: Column, q: Column) -> Column:
    """D07, of a later query behind evidence: two new terms, and a cue or a term that the question lacks."""
    return (F.size(new) >= 2) & (F.arrays_overlap(x["terms"], X.strings(X.FOLLOWUP_CUES)) | (F.size(F.array_except(new, q["terms"])) > 0))


def hits_bridge_entity(x: Column, before: Column, q: Column) -> Column:
    """The query names an entity of the observation before, or of the question."""
    seen = F.exists(before["spans"], lambda own: names_all(own, x["terms"]) | ((F.size(own) > 0) & F.exists(F.array_intersect(own, x["terms"]), lambda t: F.length(t) >= 6)))
    return E.is_true(seen) | E.is_true(F.exists(q["spans"], lambda own: names_all(own, x["terms"])))


def has_evidence(x: Column, now: Column, q: Column) -> Column:
    """The observation holds an answer, or relates to the query."""
    answered = F.exists(q["answers"], lambda own: names_all(own, now["words"]))
    both = F.size(F.array_intersect(x["terms"], now["terms"]))
    related = (both > 0) & F.arrays_overlap(now["terms"], X.strings(RELATION_TOKENS))
    return E.is_true(answered) | E.is_true(related) | E.is_true((both >= 2) & (now["number"] | now["entities"]))


def adds_relation(x: Column, new: Column, q: Column) -> Column:
    """The query has a relation token, or a term that neither earlier queries nor the question have."""
    return F.arrays_overlap(x["terms"], X.strings(RELATION_TOKENS)) | (F.size(F.array_except(new, q["terms"])) > 0)


def attributes_of(wanted: Column, terms: Column, own: Column, number: Column) -> Column:
    """Attributes whose terms the query or the observation has; a date also by any number."""
    hit = {a: F.arrays_overlap(terms, X.strings(t)) | F.arrays_overlap(own, X.strings(t)) for a, t in ATTRIBUTE_TERMS.items()}
    hit["date"] = hit["date"] | number
    return F.array_compact(F.array(*(F.when(F.array_contains(wanted, a) & h, F.lit(a)) for a, h in hit.items())))


def matched_attributes(wanted: Column, terms: Column, body: Column) -> Column:
    return attributes_of(wanted, terms, X.query_terms(body), body.rlike(X.NUMBER))


FOUND = "array<struct<turn_index:int,query:string,observation:string,helpful:boolean,evidence:boolean,hop:array<string>>>"


def search_turns(df: DataFrame) -> DataFrame:
    """Df with found, an element for each search turn.

    turn_index counts assistant turns; observation is the next turn's, where that is a tool's; helpful, evidence and hop
    (the attributes that a final-hop search matches) are the detectors' answers. One fold over a trajectory's turns, whose state
    holds what was asked so far and the tool turn behind the search before; nothing is exploded or shuffled.
    """
    seen_type = "struct<role:string,query:string,norm:string,terms:array<string>,observation:string,evidence:boolean,number:boolean,entities:boolean,words:array<string>,spans:array<array<string>>>"
    d = df.withColumns({"_turns": _turn_features(F.col("turns")), "_question": _question_features()})
    # each turn with the one behind it, where that is a tool's
    pairs = F.transform("_turns", lambda t, i: F.struct(t.alias("t"), let(F.get(F.col("_turns"), i + 1), lambda n: F.when(n["role"] == "tool", n)).alias("now")))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("said"), none.alias("asked"), none.alias("old"), F.lit(None).cast(seen_type).alias("before"), F.array().cast(FOUND).alias("found"))

    def step(state, pair):
        x, now, before, q = pair["t"], pair["now"], state["before"], F.get(F.col("_question"), F.lit(0))

        def judged(new):
            def labels(z):
                both = z["open"] & E.is_true(now["evidence"])
                sound = let(both & hits_bridge_entity(x, before, q) & has_evidence(x, now, q), lambda ok: F.struct(ok.alias("ok"), F.when(ok, attributes_of(q["wanted"], x["terms"], now["terms"], now["number"])).otherwise(none).alias("hop")))
                return let(sound, lambda s: F.struct(state["said"].alias("turn_index"), x["query"].alias("query"), now["observation"].alias("observation"), E.is_true(z["open"] & helpful_bridge(x, new, q)).alias("helpful"), E.is_true(s["ok"] & adds_relation(x, new, q)).alias("evidence"), s["hop"].alias("hop")))

            return let(F.struct((is_later(x["norm"], state["asked"]) & E.is_true(before["evidence"])).alias("open")), labels)

        found = F.concat(state["found"], F.array(let(F.array_except(x["terms"], state["old"]), judged)))
        asked = F.when(x["norm"] != "", F.array_union(state["asked"], F.array(x["norm"]))).otherwise(state["asked"])
        after = F.struct((state["said"] + 1).alias("said"), asked.alias("asked"), F.array_union(state["old"], x["terms"]).alias("old"), now.alias("before"), found.cast(FOUND).alias("found"))
        told = F.struct((state["said"] + F.when(x["role"] == "assistant", 1).otherwise(0)).alias("said"), state["asked"].alias("asked"), state["old"].alias("old"), before.alias("before"), state["found"].alias("found"))
        return F.when(x["query"].isNotNull(), after).otherwise(told)

    return d.withColumn("found", F.aggregate(pairs, start, step, lambda s: s["found"])).drop("_turns", "_question")


def _rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """A row for each struct of an array column. An outer explode, since for an inner one Spark would compute the array once more to filter by its size."""
    return df.select(key, F.explode_outer(column).alias("_e")).where("_e is not null").select(key, "_e.*")


def found_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """A row for each search turn: the key and the fields of found."""
    return _rows(search_turns(df), "found", key)


def early_answer_risk(answer: Column) -> Column:
    """D13, over trajectories with queries."""
    first = F.try_element_at(E.tool_turns(F.col("turns")), F.lit(1))
    body = F.concat_ws(" ", F.coalesce("question", F.lit("")), F.array_join("queries", " "), E.event_text(first), F.coalesce(answer, F.lit("")))
    many = F.size(X.entity_spans(body)) + F.size(F.array_distinct(X.all_matches(body, X.NUMBER))) >= 3
    return E.is_true((F.col("search_calls") <= 1) & (F.col("stop_reason") == "answer") & has_cue(F.col("question"), EARLY_CUES) & E.is_evidence(first) & many)


def covered_attributes(wanted: Column) -> Column:
    """Attributes that the queries cover; what covers a date depends on the question."""
    terms = X.query_terms(F.array_join("queries", " "))
    q = F.col("question")
    date = F.concat(X.strings(["date", "year"]), F.when(has_cue(q, ["birth", "born", "older", "younger"]), X.strings(["birth", "birthdate", "born"])).otherwise(X.strings([])), F.when(has_cue(q, ["death", "die", "died", "died earlier"]), X.strings(["death", "deathdate", "die", "died"])).otherwise(X.strings([])))
    return F.array_compact(F.array(*(F.when(F.array_contains(wanted, a) & F.arrays_overlap(terms, date if a == "date" else X.strings(t)), F.lit(a)) for a, t in ATTRIBUTE_TERMS.items())))


def missing_attributes(answer: Column) -> Column:
    """Attributes whose absence makes the answer risky; empty where there is no risk."""
    wanted = required_attributes(F.col("question"))
    missing, own = F.array_except(wanted, covered_attributes(wanted)), X.answer_terms(answer)
    supported = F.exists(E.tool_turns(F.col("turns")), lambda t: X.subset(own, X.query_terms(E.event_text(t))) & (F.size(matched_attributes(wanted, X.strings([]), E.event_text(t))) > 0))
    risky = (F.col("search_calls") > 0) & (F.col("stop_reason") == "answer") & F.exists("turns", E.is_evidence) & ~((F.size(own) > 0) & E.is_true(supported))
    return F.when(E.is_true(risky), missing).otherwise(X.strings([]))


def guard_reason() -> Column:
    """D15."""
    base = ~E.is_true(F.col("exact_match")) & (F.col("search_calls") > 0) & ~E.is_true(F.col("valid_format"))
    return F.when(base & (F.col("stop_reason") == "max_search_calls"), "max_search_no_answer_after_search").when(base & F.col("stop_reason").isin("answer", "invalid_format"), "invalid_final_answer_format_after_search")


def final_turn_index() -> Column:
    """The last assistant turn without a tool call, else the last one."""
    own = F.filter("turns", lambda t: t["role"] == "assistant")
    plain = F.filter(F.transform(own, lambda t, i: F.when(t["tool_call"].isNull(), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(plain), F.when(F.size(own) > 0, F.size(own) - 1))


@dataclass(frozen=True)
class Credit:
    """A policy (none, helpful_bridge, evidence_bridge or final_hop_bridge) with its weights."""

    policy: str = "none"
    helpful_bonus: float = 0.0
    evidence_bonus: float = 0.0
    final_hop_bonus: float = 0.0
    early_penalty: float = 0.0
    missing_penalty: float = 0.0
    guard_penalty: float = 0.0

    def __post_init__(self):
        if self.policy not in ("none", "helpful_bridge", "evidence_bridge", "final_hop_bridge"):
            raise ValueError(f"no such policy: {self.policy}")
        if min(v for v in vars(self).values() if not isinstance(v, str)) < 0:
            raise ValueError("weights must be non-negative")


def _labels(df: DataFrame, credit: Credit) -> DataFrame:
    """df with labels: an array of turn_index, label, query and bonus by turn_index; of several labels of a turn the last in PRECEDENCE counts."""
    d = df.withColumn("queries", E.tool_queries(F.col("turns"))).withColumn("_answer", X.extract_answer(E.final_text(F.col("turns"), any_kind=True)))
    wrong = E.is_true(F.col("valid_format")) & ~E.is_true(F.col("exact_match"))
    kind, parts = "array<struct<turn_index:int,rank:int,label:string,query:string,bonus:double>>", []
    one = lambda turn, k, query, bonus: F.struct(turn.alias("turn_index"), F.lit(k).alias("rank"), F.lit(PRECEDENCE[k]).alias("label"), query.alias("query"), F.lit(bonus).alias("bonus"))

    def search(k, rule, bonus):
        hits = F.transform(F.filter("found", rule), lambda f: one(f["turn_index"], k, f["query"], bonus))
        parts.append(F.when(wrong, hits).otherwise(F.array().cast(kind)).cast(kind))

    def final(k, rule, penalty):
        parts.append(F.when(rule & F.col("_final").isNotNull(), F.array(one(F.col("_final"), k, F.lit(None).cast("string"), -penalty))).otherwise(F.array().cast(kind)).cast(kind))

    hop = credit.policy == "final_hop_bridge"
    if credit.policy == "helpful_bridge" and credit.helpful_bonus:
        search(0, lambda f: f["helpful"], credit.helpful_bonus)
    if hop and credit.guard_penalty:
        final(1, guard_reason().isNotNull(), credit.guard_penalty)
    if credit.policy in ("evidence_bridge", "final_hop_bridge"):
        if credit.evidence_bonus:
            search(2, lambda f: f["evidence"], credit.evidence_bonus)
        if hop and credit.final_hop_bonus:
            search(3, lambda f: F.size(f["hop"]) > 0, credit.final_hop_bonus)
        if credit.early_penalty:
            final(4, wrong & early_answer_risk(F.col("_answer")), credit.early_penalty)
        if hop and credit.missing_penalty:
            final(5, wrong & (F.size(missing_attributes(F.col("_answer"))) > 0), credit.missing_penalty)
    d = search_turns(d).withColumn("_final", final_turn_index()).withColumn("_all", F.concat(F.array().cast(kind), *parts))
    last = F.filter("_all", lambda c: ~F.exists("_all", lambda o: (o["turn_index"] == c["turn_index"]) & (o["rank"] > c["rank"])))
    labels = F.array_sort(F.transform(last, lambda c: F.struct(*(c[n].alias(n) for n in ("turn_index", "label", "query", "bonus")))))
    return d.withColumn("labels", labels).drop("queries", "_answer", "found", "_final", "_all")


def credit_labels(df: DataFrame, credit: Credit, key: str = "id") -> DataFrame:
    """(key, turn_index, label, query, bonus) of the credited turns."""
    return _rows(_labels(df, credit), "labels", key)


def effective_advantage(advantage: Column, bonus: Column) -> Column:
    """What a turn's advantage becomes: a bonus lifts it from zero at least, a penalty lowers it from zero at most."""
    return F.when(bonus.isNull(), advantage).when(bonus >= 0, F.greatest(advantage, F.lit(0.0)) + bonus).otherwise(F.least(advantage, F.lit(0.0)) + bonus)


def apply_credit(df: DataFrame, credit: Credit) -> DataFrame:
    """Df with turn_credits, an array of structs by turn_index; null where no turn is credited."""
    marked = F.transform("labels", lambda c: F.struct(*(c[n].alias(n) for n in ("turn_index", "label", "query", "bonus")), effective_advantage(F.col("advantage"), c["bonus"]).alias("effective_advantage")))
    return _labels(df, credit).withColumn("turn_credits", F.when(F.size("labels") > 0, marked)).drop("labels")


def credit_rows(df: DataFrame, credit: Credit, key: str = "id") -> DataFrame:
    """credit_labels with each turn's effective advantage."""
    return _rows(apply_credit(df, credit), "turn_credits", key)


def mark_turns(turns: Column, credits: Column) -> Column:
    """The label written onto each credited assistant turn; null for the others."""

    def label(t, i):
        n = F.size(F.filter(F.slice(turns, F.lit(1), i), lambda u: u["role"] == "assistant"))
        return F.when(t["role"] == "assistant", F.try_element_at(F.filter(credits, lambda c: c["turn_index"] == n), F.lit(1))["label"])

    return F.transform(turns, label)


def analyze(df: DataFrame, key: str = "id") -> DataFrame:
    """Per trajectory, how many turns each detector finds and which risks its answer has; credit and penalties are for wrong answers only."""
    d = search_turns(df).withColumn("queries", E.tool_queries(F.col("turns"))).withColumn("final_answer", X.extract_answer(E.final_text(F.col("turns"))))
    wrong = E.is_true(F.col("valid_format")) & ~E.is_true(F.col("exact_match"))
    turns = {"helpful_turns": lambda f: f["helpful"], "evidence_turns": lambda f: f["evidence"], "final_hop_turns": lambda f: F.size(f["hop"]) > 0}
    d = d.select(key, "data_source", E.is_true(F.col("exact_match")).alias("exact_match"), E.is_true(F.col("valid_format")).alias("valid_format"), "search_calls", F.size("found").alias("found_turns"), wrong.alias("wrong_valid"), (wrong & early_answer_risk(F.col("final_answer"))).alias("early_penalty"), (wrong & (F.size(missing_attributes(F.col("final_answer"))) > 0)).alias("missing_penalty"), guard_reason().isNotNull().alias("guard_penalty"), *(F.size(F.filter("found", rule)).cast("long").alias(c) for c, rule in turns.items()))
    return d.withColumns({f"credited_{c}": F.when(F.col("wrong_valid"), F.col(c)).otherwise(0) for c in turns})


def summarize_analysis(analyzed: DataFrame) -> DataFrame:
    """Totals of analyze(), as one row."""
    sums = ["helpful_turns", "credited_helpful_turns", "evidence_turns", "credited_evidence_turns", "final_hop_turns", "credited_final_hop_turns"]
    return analyzed.agg(
        F.count("*").alias("total"), F.count_if("wrong_valid").alias("wrong_valid"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums),
        F.count_if(F.col("evidence_turns") > 0).alias("evidence_records"), F.count_if(F.col("final_hop_turns") > 0).alias("final_hop_records"), F.count_if(F.col("wrong_valid") & ((F.col("evidence_turns") > 0) | (F.col("final_hop_turns") > 0))).alias("credited_records"),
        *(F.count_if(c).alias(f"{c}_records") for c in ("early_penalty", "missing_penalty", "guard_penalty")),
    )


#: Sections of cases, and when a row of analyze() belongs to one.
SECTIONS = {
    "evidence_candidates": "evidence_turns > 0",
    "final_hop_candidates": "final_hop_turns > 0",
    "training_evidence_credits": "credited_evidence_turns > 0",
    "training_final_hop_credits": "credited_final_hop_turns > 0",
    "early_answer_penalties": "early_penalty",
    "missing_final_hop_penalties": "missing_penalty",
    "final_answer_guard_penalties": "guard_penalty",
}


def first_cases(analyzed: DataFrame, most: int, key: str = "id", key_ids: tuple = ()) -> DataFrame:
    """(section, ord, rank and analyze()'s columns) of the first cases of each section; key_cases are those of the given ids."""
    rules = {**{name: F.expr(rule) for name, rule in SECTIONS.items()}, "key_cases": F.col(key).isin(list(key_ids)) if key_ids else F.lit(False)}
    own = F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(k).alias("ord"), F.lit(name).alias("section"))) for k, (name, rule) in enumerate(rules.items()))))
    each = analyzed.withColumn("_c", F.explode(own)).select("_c.section", "_c.ord", *analyzed.columns)
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(key))).where(F.col("rank") <= most)


def outcome_buckets(analyzed: DataFrame) -> DataFrame:
    """Trajectories by source, outcome and number of searches."""
    flag = lambda c: F.when(F.col(c), "True").otherwise("False")
    bucket = F.concat_ws("|", F.coalesce("data_source", F.lit("unknown")), F.concat(F.lit("exact="), flag("exact_match")), F.concat(F.lit("format="), flag("valid_format")), F.concat(F.lit("search_calls="), F.col("search_calls").cast("string")))
    return analyzed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
