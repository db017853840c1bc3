"""Chat messages and tool observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a model was trained with; results that count their tokens depend on them.
TOOL_NAME = "search"
REMINDER = "Reminder: if the result only identifies a bridge entity, search that entity or relation before answering. Final output must be exactly one line: Answer: <shortest single answer span>. If you have searched three times, answer with the best supported span instead of searching again."
SYSTEM_PROMPT = """You answer factual questions with help from a search tool.
Search before giving the final answer. Use concise English queries.
Do not answer from memory before seeing at least one search result.
For multi-hop or relation questions, first identify the bridge entity, then search that entity or relation before answering.
Call search exactly once per assistant turn. Wait for the tool result before making another search call.
Do not stop after a search result that only identifies an intermediate person, work, place, date, role, or organization.
Use at most three searches when possible. After three searches, answer with the best supported short span instead of asking for another search.
When ready, output exactly one line and nothing else:
Answer: <shortest single answer span>
Do not include reasoning, markdown, citations, parentheses, alternatives, or words such as "or" after Answer:.
Do not call a tool and give the final answer in the same turn."""


def tool_content(c: Column) -> Column:
    """An observation with the reminder."""
    return F.concat(c, F.lit("\n\n"), F.lit(REMINDER))


def initial_messages(question: Column) -> Column:
    """The first messages of a chat."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", question))


def tool_message(call_id: Column, content: Column) -> Column:
    """An observation as a message."""
    return F.struct(F.lit("tool").alias("role"), call_id.alias("tool_call_id"), F.lit(TOOL_NAME).alias("name"), tool_content(content).alias("content"))


def format_items(items: Column) -> Column:
    """Each item as a numbered block of four lines."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Title: "), text(x["title"]), F.lit("\n    Content: "), text(x["content"]), F.lit("\n    Source: "), text(x["source"]), F.lit("\n    URL: "), text(x["url"])))


def observation_blocks(ok: Column, items: Column, error: Column) -> Column:
    """What an observation may consist of: item blocks, or a line that says there are none."""
    return F.when(~F.coalesce(ok, F.lit(False)), F.array(F.concat(F.lit("Search error: "), F.coalesce(error, F.lit("unknown error"))))).when(F.coalesce(F.size(items), F.lit(0)) < 1, F.array(F.lit("Search returned no results."))).otherwise(format_items(items))


def fit_blocks(blocks: Column, count, budget: int) -> Column:
    """The longest run of first blocks that fits the budget together with the reminder; null if none does.

    count gives a text's tokens; it must be additive over blocks.
    """
    sizes = F.transform(blocks, count)
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(blocks), F.lit(1))), lambda n: F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x) + count(F.lit(REMINDER)) <= budget)
    most = F.coalesce(F.array_max(fits), F.lit(0))
    return F.when(most > 0, F.array_join(F.slice(blocks, F.lit(1), most), "\n\n"))
