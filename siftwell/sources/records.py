"""Trajectory records as they are: every key of a JSON object kept, in a VARIANT column.

The typed columns of `jsonl.read_records` are what the detectors need; a record may hold more at any level
(its own keys, its metadata's, its turns'). Here a record is one VARIANT: defaults are filled in, typed
columns can be written over its keys and values into its turns, and it is written back whole, keys sorted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jsonl

# What a record without a key gets.
DEFAULTS = {"question": "", "answers": [], "data_source": "", "turns": [], "reward": None, "advantage": None, "valid_format": None, "exact_match": None, "search_calls": 0, "tool_failures": 0, "metadata": {}}
_MAP = "map<string,variant>"


def as_map(value: Column) -> Column:
    """The keys of a VARIANT object."""
    return value.cast(_MAP)


def to_variant(c: Column, kind: str) -> Column:
    """A column of a type as VARIANT; a null becomes JSON's."""
    own = F.to_variant_object(c) if kind.startswith(("array", "struct", "map")) else c.cast("variant")
    return F.coalesce(c if kind == "variant" else own, F.parse_json(F.lit("null")))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def normalize(record: Column) -> Column:
    """The record with all default keys, answers as a list and counts as whole numbers; every other key as it is."""
    own, defaults = as_map(record), as_map(F.parse_json(F.lit(json.dumps(DEFAULTS))))
    count = lambda c: F.coalesce(F.try_variant_get(record, f"$.{c}", "int"), F.lit(0)).cast("variant")
    answers = F.when(F.map_contains_key(own, "answers"), F.when(_is(own["answers"], "ARRAY"), own["answers"]).otherwise(F.to_variant_object(F.array(own["answers"])))).otherwise(F.parse_json(F.lit("[]")))
    fixed = F.create_map(F.lit("answers"), answers, F.lit("search_calls"), count("search_calls"), F.lit("tool_failures"), count("tool_failures"))
    plain = F.map_filter(own, lambda k, _: ~k.isin("answers", "search_calls", "tool_failures"))
    missing = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k) & ~k.isin("answers", "search_calls", "tool_failures"))
    return F.to_variant_object(F.map_concat(missing, plain, fixed))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, line, record), without the summary rows; a line that is no such record raises if strict, else is left out."""
    rows = jsonl.lines(spark, path).withColumn("r", F.try_parse_json("value"))
    bad = F.col("r").isNull() | ~_is(F.col("r"), "OBJECT")
    for key, kind in (("turns", "ARRAY"), ("metadata", "OBJECT")):
        held = F.variant_get("r", f"$.{key}", "variant")
        bad = bad | (_is(F.col("r"), "OBJECT") & held.isNotNull() & ~_is(held, kind))
    rows = jsonl.check(rows, bad, "invalid record") if strict else rows.where(~bad)
    kept = rows.where(F.coalesce(F.try_variant_get("r", "$.type", "string"), F.lit("")) != "summary")
    return kept.select("file", "line", normalize(F.col("r")).alias("record"))


def typed(df: DataFrame) -> DataFrame:
    """df with the columns of jsonl.read_records beside record."""
    parsed = df.withColumn("r", F.from_json(F.to_json("record"), jsonl.RECORD))
    return jsonl.normalize_records(parsed.select("file", "line", "record", "r.*"), keep=("record",))


def update(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the named columns written over the record's keys of the same names."""
    kinds, own = dict(df.dtypes), as_map(F.col("record"))
    new = F.create_map(*(x for c in columns for x in (F.lit(c), to_variant(F.col(c), kinds[c]))))
    return df.withColumn("record", F.to_variant_object(F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*columns)), new)))


def mark_turns(df: DataFrame, key: str, values: Column) -> DataFrame:
    """Df whose record's turn k holds the k-th of the values (VARIANTs) under the key; turns without a value stay as they are."""
    turns = F.variant_get("record", "$.turns", f"array<{_MAP}>")

    def marked(turn, k):
        value = F.get(values, k)
        return F.when(value.isNull(), turn).otherwise(F.map_concat(F.map_filter(turn, lambda name, _: name != key), F.create_map(F.lit(key), value)))

    own = as_map(F.col("record"))
    new = F.create_map(F.lit("turns"), F.to_variant_object(F.transform(turns, marked)))
    return df.withColumn("record", F.to_variant_object(F.map_concat(F.map_filter(own, lambda k, _: k != "turns"), new)))


def write(df: DataFrame, path: str) -> None:
    """A line for each record, all keys sorted."""
    df.select(F.to_json("record").alias("value")).write.text(path)
