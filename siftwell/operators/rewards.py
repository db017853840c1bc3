"""Answer scoring, reward shaping and reward sensitivity."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import turns as E
from . import diagnostics as D


@dataclass(frozen=True)
class Shaping:
    """Weights of a shaped reward (D01); all non-negative."""

    duplicate_query_penalty: float = 0.0
    empty_result_penalty: float = 0.0
    max_search_no_answer_penalty: float = 0.0
    verbose_answer_penalty: float = 0.0
    verbose_answer_token_threshold: int = 0
    bad_max_search_penalty: float = 0.0
    date_granularity_penalty: float = 0.0
    multi_candidate_answer_penalty: float = 0.0
    helpful_followup_bonus: float = 0.0
    no_search_penalty: float = 0.0

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) < 0:
                raise ValueError(f"{f.name} must be non-negative")


# Short names of the weights, and the default configurations.
SHORT_NAMES = {"duplicate": "duplicate_query_penalty", "empty": "empty_result_penalty", "max_search": "max_search_no_answer_penalty", "verbose": "verbose_answer_penalty", "verbose_threshold": "verbose_answer_token_threshold", "bad_max_search": "bad_max_search_penalty", "date_granularity": "date_granularity_penalty", "multi_candidate": "multi_candidate_answer_penalty", "helpful_followup": "helpful_followup_bonus", "no_search": "no_search_penalty"}
DEFAULT_CONFIGS = {
    "base_reward_v0": {},
    "penalty_v1": {"duplicate": 0.05, "empty": 0.03, "max_search": 0.05, "verbose": 0.02, "verbose_threshold": 8},
    "penalty_v2_candidate": {"duplicate": 0.03, "empty": 0.01},
    "penalty_v2_no_empty": {"duplicate": 0.03},
    "penalty_v3_followup_aware": {"duplicate": 0.03, "empty": 0.01, "bad_max_search": 0.01, "date_granularity": 0.05, "multi_candidate": 0.02},
    "reward_v4_followup_bonus": {"duplicate": 0.03, "empty": 0.01, "bad_max_search": 0.01, "date_granularity": 0.05, "multi_candidate": 0.02, "helpful_followup": 0.02},
    "reward_v5_no_search_guard": {"duplicate": 0.02, "bad_max_search": 0.005, "date_granularity": 0.05, "multi_candidate": 0.02, "no_search": 0.03},
}
#: Penalties in the order in which they are subtracted, then the bonus.
TERMS = ["duplicate_query_penalty", "empty_result_penalty", "max_search_no_answer_penalty", "verbose_answer_penalty", "bad_max_search_penalty", "date_granularity_penalty", "multi_candidate_answer_penalty", "no_search_penalty", "helpful_followup_bonus"]


def default_configs() -> dict[str, Shaping]:
    """D03."""
    return {name: Shaping(**{SHORT_NAMES[k]: v for k, v in own.items()}) for name, own in DEFAULT_CONFIGS.items()}


def parse_config(spec: str) -> tuple[str, Shaping]:
    """Name:key=value,key=value with short names."""
    name, colon, rest = (x.strip() for x in spec.partition(":"))
    if not (name and colon and rest):
        raise ValueError("a configuration reads name:key=value,...")
    own = {}
    for item in rest.split(","):
        key, sign, value = (x.strip() for x in item.partition("="))
        if not (key and sign and value):
            raise ValueError(f"no key=value: {item!r}")
        if key not in SHORT_NAMES:
            raise ValueError(f"no such weight: {key}")
        own[SHORT_NAMES[key]] = int(value) if key == "verbose_threshold" else float(value)
    return name, Shaping(**own)


def load_configs(specs=()) -> dict[str, Shaping]:
    """The default configurations, then the given ones."""
    return default_configs() | dict(map(parse_config, specs))


def config_table(spark: SparkSession, configs: dict[str, Shaping]) -> DataFrame:
    rows = [(k, name, *asdict(c).values()) for k, (name, c) in enumerate(configs.items())]
    return spark.createDataFrame(rows, "config_ord int, config_name string, " + ", ".join(f"{f.name} {'int' if f.name.endswith('threshold') else 'double'}" for f in fields(Shaping)))


def score_answer(text: Column, references: Column) -> Column:
    """struct of reward, valid_format, exact_match and answer."""
    answer = X.extract_answer(text)
    exact = E.is_true(F.exists(references, lambda r: X.normalize_answer(r) == X.normalize_answer(answer)))
    reward = F.when(answer.isNull(), -0.1).when(exact, 1.0).otherwise(0.0)
    return F.struct(reward.alias("reward"), answer.isNotNull().alias("valid_format"), (answer.isNotNull() & exact).alias("exact_match"), answer.alias("answer"))


def base_reward(valid: Column, exact: Column) -> Column:
    """the ladder from stored flags."""
    return F.when(~E.is_true(valid), -0.1).when(E.is_true(exact), 1.0).otherwise(0.0)


def no_search_failure() -> Column:
    """F07, over diagnosed columns; a direct wrong answer counts."""
    some = F.col("direct_correct") | F.col("searched_correct") | F.col("searched_wrong") | F.col("searched_invalid_format")
    return ~some & (F.col("tool_observation_count") == 0) & (F.col("pending_tool_call_count") == 0)


def features(df: DataFrame, key: str = "id") -> DataFrame:
    """What shaping needs of each trajectory, computed once for all configurations."""
    d = D.offline(df, key)
    valid = E.is_true(F.col("valid_format"))
    exact = valid & E.is_true(F.col("exact_match"))
    answered = F.col("final_answer").isNotNull() & (F.size("answers") > 0)
    return d.withColumns({
        "base_reward": base_reward(F.col("valid_format"), F.col("exact_match")), "base_exact": exact, "base_valid": valid,
        "_none": no_search_failure(), "_date": answered & D.granularity_miss(F.col("final_answer"), F.col("answers")),
        "_multi": answered & D.multi_candidate(F.col("final_answer"), F.col("answers")), "_words": X.word_count(F.col("final_answer")),
    })


def rescore(df: DataFrame, configs: dict[str, Shaping], key: str = "id") -> DataFrame:
    """Every trajectory under every configuration. The configurations are a fixed, short table."""
    keep = [key, "question", "final_answer", "base_reward", "base_exact", "base_valid", "duplicate_query_count", "empty_observation_count", "max_search_no_answer", *D.OFFLINE, "_none", "_date", "_multi", "_words"]
    both = features(df, key).select(keep).crossJoin(F.broadcast(config_table(df.sparkSession, configs)))
    applies = {
        "duplicate_query_penalty": F.col("duplicate_query_count") > 0, "empty_result_penalty": F.col("empty_observation_count") > 0,
        "max_search_no_answer_penalty": F.col("max_search_no_answer"), "bad_max_search_penalty": F.col("bad_max_search_loop"),
        "verbose_answer_penalty": F.col("final_answer").isNotNull() & (F.col("verbose_answer_token_threshold") > 0) & (F.col("_words") > F.col("verbose_answer_token_threshold")),
        "date_granularity_penalty": F.col("_date"), "multi_candidate_answer_penalty": F.col("_multi"), "no_search_penalty": F.col("_none"),
        "helpful_followup_bonus": F.col("base_valid") & F.col("helpful_followup_query") & ~F.col("bad_max_search_loop"),
    }
    shaped = both.withColumns({c: F.when(~F.col("base_exact") & applies[c], F.col(c)).otherwise(0.0) for c in TERMS})
    final = F.col("base_reward")
    for c in TERMS[:-1]:
        final = final - F.col(c)
    done = shaped.withColumn("final_reward", final + F.col(TERMS[-1])).withColumn("reward_delta", F.col("final_reward") - F.col("base_reward"))
    return done.select("config_ord", "config_name", key, "question", "final_answer", F.col("base_exact").alias("exact_match"), F.col("base_valid").alias("valid_format"), "base_reward", "final_reward", "reward_delta", *TERMS, *D.OFFLINE)


def summarize(results: DataFrame) -> DataFrame:
    """One row per configuration."""
    less, more = F.col("reward_delta") < 0, F.col("reward_delta") > 0
    wrong = F.col("valid_format") & ~F.col("exact_match")
    n = lambda c, name: F.count_if(c).alias(name)
    paid = {"duplicate": TERMS[0], "empty": TERMS[1], "max_search": TERMS[2], "verbose": TERMS[3], "bad_max_search": TERMS[4], "date_granularity": TERMS[5], "multi_candidate": TERMS[6], "no_search": TERMS[7]}
    flags = {"missing_followup": "missing_followup_query", "helpful_followup": "helpful_followup_query", "bad_max_search_loop": "bad_max_search_loop", "possible_alias": "possible_alias_match", "answer_granularity": "answer_granularity_miss", "multi_candidate_answer": "multi_candidate_answer"}
    return results.groupBy("config_ord", "config_name").agg(
        F.count("*").alias("total"), F.avg("base_reward").alias("mean_base_reward"), F.avg("final_reward").alias("mean_final_reward"), F.avg("reward_delta").alias("mean_delta"),
        n(less, "penalized_count"), n(less & F.col("exact_match"), "correct_penalized_count"), n(less & wrong, "wrong_valid_penalized_count"),
        *(n(less & (F.col(c) > 0), f"{k}_penalized_count") for k, c in paid.items()), *(n(less & F.col(c), f"{k}_penalized_count") for k, c in flags.items()),
        n(more, "boosted_count"), n(F.col("helpful_followup_bonus") > 0, "helpful_followup_bonus_count"), n(more & F.col("exact_match"), "correct_boosted_count"), n(more & wrong, "wrong_valid_boosted_count"),
        n(more & F.col("missing_followup_query"), "missing_followup_boosted_count"), n(more & F.col("helpful_followup_query"), "helpful_followup_boosted_count"),
    )


def score_trajectories(df: DataFrame, shaping: Shaping, key: str = "id") -> DataFrame:
    """Score the final text, then shape under one configuration."""
    scored = df.withColumn("_s", score_answer(E.final_text(F.col("turns"), any_kind=True), F.col("answers")))
    scored = scored.withColumns({"valid_format": F.col("_s.valid_format"), "exact_match": F.col("_s.exact_match")}).drop("_s")
    return rescore(scored, {"online": shaping}, key).drop("config_ord", "config_name")
