"""Text functions over columns: answers, queries, terms and entity spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that results depend on.
FOLLOWUP_CUES = ["born", "birth", "child", "competition", "date", "death", "died", "director", "father", "founder", "grandfather", "grandmother", "husband", "mother", "place", "school", "studied", "study", "wife", "winner", "writer"]
STOPWORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "what", "when", "where", "which", "who", "whose"]
ENTITY = r"\b[A-Z][A-Za-z0-9]*(?:[-'][A-Za-z0-9]+)?(?:\s+[A-Z][A-Za-z0-9]*(?:[-'][A-Za-z0-9]+)?){0,4}\b"
NAMED_ENTITY = r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"
YEAR = r"\b(1[5-9]\d{2}|20\d{2})\b"
MULTI_CANDIDATE = r"(?iU)\b(or|或者|或)\b|/|;|\((?:[^)]*\b(or|for)\b[^)]*)\)"
ANSWER_LINE = r"(?imdU)^\s*Answer:\s*(.*?)\s*$"
TOOL_CALL = r"(?s)<tool_call>\s*<function=search>\s*<parameter=query>\s*(.*?)\s*</parameter>\s*</function>\s*</tool_call>"


def strings(values) -> Column:
    """A constant array of strings."""
    return F.expr(f"array({quoted(values)})") if values else F.array().cast("array<string>")


def quoted(values) -> str:
    """SQL string literals, which are made in one step where columns would take one for each value."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def split_words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def normalize_answer(c: Column) -> Column:
    """Lower case, without punctuation and articles, white space collapsed."""
    bare = F.regexp_replace(F.lower(c), r"\p{P}", "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def extract_answer(c: Column) -> Column:
    """The one non-empty answer line, or null."""
    found = F.regexp_extract_all(c, F.lit(ANSWER_LINE), F.lit(1))
    return F.when(F.size(found) == 1, F.nullif(squeeze_ends(F.get(found, F.lit(0))), F.lit("")))


def squeeze_ends(c: Column) -> Column:
    """Without leading and trailing white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_assistant(c: Column) -> Column:
    """Struct of kind (tool, answer or invalid), content and query."""
    calls = F.regexp_extract_all(c, F.lit(TOOL_CALL), F.lit(1))
    query, n = squeeze_ends(F.get(calls, F.lit(0))), F.size(calls)
    behind = F.regexp_extract(c, TOOL_CALL + r"(.*)$", 2)
    kind = F.when(n == 0, F.when(F.contains(c, F.lit("<tool_call>")), "invalid").otherwise("answer")).when((n != 1) | (squeeze_ends(behind) != "") | (query == "") | query.rlike("[<>]"), "invalid").otherwise("tool")
    content = F.when(kind == "tool", F.regexp_extract(c, "(?s)^(.*?)" + TOOL_CALL.removeprefix("(?s)"), 1)).otherwise(c)
    return F.struct(kind.alias("kind"), squeeze_ends(content).alias("content"), F.when(kind == "tool", query).alias("query"))


def normalize_query(c: Column) -> Column:
    """P07."""
    return squeeze(F.lower(c))


def query_terms(c: Column) -> Column:
    """Distinct terms of over two letters that are no stopwords."""
    found = F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_except(F.filter(found, lambda t: F.length(t) > 2), strings(STOPWORDS))


def clean_answers(c: Column) -> Column:
    """Trimmed, without empty ones, each once in first order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), squeeze_ends), lambda a: a != ""))


def split_keys(c: Column) -> Column:
    """Entries between commas and line ends."""
    return clean_answers(F.split(c, "[,\n]"))


def tokenize(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(c: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.size(split_words(c)), F.lit(0))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))


def entity_spans(c: Column) -> Column:
    """Capitalised phrases with at least one query term."""
    return F.filter(F.array_distinct(all_matches(c, ENTITY)), lambda s: F.size(query_terms(s)) > 0)


def named_entity_count(c: Column) -> Column:
    """P22."""
    return F.size(F.array_distinct(all_matches(c, NAMED_ENTITY)))


def answer_terms(c: Column) -> Column:
    """Words of the normalised answer with over one letter, less stopwords."""
    return F.array_except(F.filter(F.split(normalize_answer(F.coalesce(c, F.lit(""))), " "), lambda t: F.length(t) > 1), strings(STOPWORDS))


def subset(a: Column, b: Column) -> Column:
    """Whether array b holds all of array a."""
    return F.size(F.array_except(a, b)) == 0


def token_subset(left: Column, right: Column) -> Column:
    """P25: one holds the other's tokens, or the overlap is 0.8 of the smaller."""
    a, b = (F.array_distinct(F.filter(F.split(x, " "), lambda t: t != "")) for x in (left, right))
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when(least == 0, False).when(least == 1, both == 1).otherwise(both / least >= 0.8)


def suffix_prefix_overlap(a: Column, b: Column) -> Column:
    """Length of the longest suffix of array a that begins array b."""
    most = F.least(F.size(a), F.size(b))
    sizes = F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda n: F.slice(a, F.size(a) - n + 1, n) == F.slice(b, F.lit(1), n))
    return F.array_max(sizes)


def year_set(c: Column) -> Column:
    return F.array_distinct(all_matches(c, YEAR, 1))
