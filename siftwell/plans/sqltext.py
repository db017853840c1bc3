"""DuckDB forms of the text functions, for the oracle."""

from __future__ import annotations

from ..functions import text as X


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def norm(c: str) -> str:
    out = f"regexp_replace(lower({c}), '\\p{{P}}', '', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"
    return squeeze(out)


def answer(c: str) -> str:
    m = f"regexp_extract_all({c}, '(?im)^\\s*Answer:\\s*(.*?)\\s*$', 1)"
    return f"CASE WHEN len({m}) = 1 THEN nullif(trim({m}[1]), '') END"


def words(c: str) -> str:
    return f"list_filter(string_split({squeeze(c)}, ' '), lambda w: w <> '')"


def terms(c: str) -> str:
    return f"list_distinct(list_filter(string_split(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: length(t) > 2 AND t NOT IN ({quoted(X.STOPWORDS)})))"


def answer_terms(c: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(f'coalesce({c}, {chr(39)}{chr(39)})')}, ' '), lambda t: length(t) > 1 AND t NOT IN ({quoted(X.STOPWORDS)})))"


def matches(c: str, pattern: str, group: int = 0) -> str:
    # the oracle's word boundaries know ASCII alone: other letters become a word character that no pattern matches
    plain = f"regexp_replace(regexp_replace(coalesce({c}, ''), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '.', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
    return f"regexp_extract_all({plain}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


def spans(c: str) -> str:
    return f"list_filter(list_distinct({matches(c, X.ENTITY)}), lambda s: len({terms('s')}) > 0)"


def has_any(a: str, values) -> str:
    return f"list_has_any({a}, [{quoted(values)}])"


def cue(c: str, cues) -> str:
    return f"len(list_filter([{quoted(cues)}], lambda c: contains(lower({c}), c))) > 0"


def queries(turns: str = "turns") -> str:
    return f"list_transform(list_filter({turns}, lambda t: t.query IS NOT NULL), lambda t: t.query)"


def event_text(t: str) -> str:
    return f"array_to_string(list_concat(flatten(list_transform(coalesce({t}.items, []), lambda itm: list_filter([itm.title, itm.source, itm.content], lambda v: v <> ''))), [coalesce(nullif({t}.observation, ''), {t}.text, '')]), ' ')"


def evidence(t: str) -> str:
    return f"coalesce({t}.role = 'tool' AND {t}.ok AND len({t}.items) > 0, false)"
