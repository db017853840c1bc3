"""JSON payloads of a search service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze_ends

# Fields of a payload, and what they hold when a key is exhausted.
FIELDS = ["Code", "code", "ErrorCode", "error_code", "Message", "message", "Error", "error"]
DATA_FIELDS = ["Code", "code", "Message", "message", "Error", "error"]
RATE_LIMIT_MARKERS = ["429", "rate limit", "rate_limit", "too many", "quota", "限流", "频率", "次数", "配额"]


def indicates_rate_limit(payload: Column, markers: list[str] = RATE_LIMIT_MARKERS) -> Column:
    """A marker in a code or message field, at the top or under Data."""
    paths = [f"$.{n}" for n in FIELDS] + [f"$.Data.{n}" for n in DATA_FIELDS]
    said = F.lower(F.concat_ws(" ", *(F.get_json_object(payload, p) for p in paths)))
    return F.coalesce(F.exists(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(said, m)), F.lit(False))


def parse_item(item: Column, default_source: str = "web") -> Column:
    """P10: struct of title, content, url and source of one result."""
    field = lambda n: F.coalesce(F.get_json_object(item, f"$.{n}"), F.lit(""))
    source = F.concat_ws(" / ", F.coalesce(F.nullif(field("ContentType"), F.lit("")), F.lit(default_source)), F.nullif(field("AuthorName"), F.lit("")))
    return F.struct(squeeze_ends(F.coalesce(F.nullif(field("Title"), F.lit("")), F.lit("Untitled"))).alias("title"), F.left(squeeze_ends(field("ContentText")), F.lit(1200)).alias("content"), squeeze_ends(field("Url")).alias("url"), source.alias("source"))


def excerpt(body: Column, most: int = 4000) -> Column:
    """Struct of the first characters of an error body and whether there were more."""
    return F.struct(F.left(body, F.lit(most)).alias("excerpt"), (F.length(body) > most).alias("truncated"))
