"""Functions over a trajectory's turns: an array of structs in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = "struct<id:string,title:string,content:string,url:string,source:string,score:double>"
TURNS = f"array<struct<role:string,text:string,parsed_kind:string,tool_call:struct<name:string,query:string>,ok:boolean,items:array<{ITEM}>,observation:string,error_type:string,latency:double>>"


def is_true(c: Column) -> Column:
    """Strictly true: null is false."""
    return F.coalesce(c, F.lit(False))


def tool_queries(turns: Column) -> Column:
    """Queries of all turns that have one, in order."""
    return F.transform(F.filter(turns, lambda t: t["tool_call"]["query"].isNotNull()), lambda t: t["tool_call"]["query"])


def tool_turns(turns: Column) -> Column:
    return F.filter(turns, lambda t: t["role"] == "tool")


def is_empty_observation(t: Column) -> Column:
    """a successful search without items; missing items are not empty ones."""
    return is_true((t["role"] == "tool") & t["items"].isNotNull() & (F.size(t["items"]) == 0) & t["ok"])


def is_evidence(t: Column) -> Column:
    """a successful search with items."""
    return is_true((t["role"] == "tool") & t["ok"] & (F.size(t["items"]) > 0))


def count_where(turns: Column, rule) -> Column:
    return F.size(F.filter(turns, rule))


def final_text(turns: Column, any_kind: bool = False) -> Column:
    """The last assistant text; unless any_kind, of a turn that is no tool call."""
    kept = F.filter(turns, lambda t: (t["role"] == "assistant") & (F.lit(any_kind) | (F.coalesce(t["parsed_kind"], F.lit("")) != "tool")))
    return F.coalesce(F.try_element_at(kept, F.lit(-1))["text"], F.lit(""))


def observation_text(turns: Column) -> Column:
    """P19."""
    return F.array_join(F.transform(tool_turns(turns), lambda t: F.coalesce(F.nullif(t["observation"], F.lit("")), t["text"], F.lit(""))), " ")


def event_text(t: Column) -> Column:
    """P20: titles, sources and contents of the items, then the observation."""
    parts = F.flatten(F.transform(F.coalesce(t["items"], F.array()), lambda i: F.filter(F.array(i["title"], i["source"], i["content"]), lambda v: v.isNotNull() & (v != ""))))
    return F.concat_ws(" ", parts, F.coalesce(F.nullif(t["observation"], F.lit("")), t["text"], F.lit("")))
