"""Entity queries over documents of every language and of none, against Python's patterns."""

import re

from siftwell.functions import text as X
from siftwell.plans import text_queries  # noqa: F401
from siftwell.plans.registry import QUERIES

TEXTS = [("en", "Ada Lovelace met Charles Babbage in London."), ("fr", "L'École de Jean Moulin à Évry; Été Paris, Marie Curie-Skłodowska."), ("de", "Über Zürich flog Otto Groß nach Köln."), ("es", "Ñandú y Juan Pérez en Ávila 1912."), (None, "The Who"), ("fr", None), ("ru", "Анна Каренина and Leo Tolstoy")]


def test_every_language_has_a_row(spark, tmp_path):
    rows = [(k, text, lang, "s", len(text or "")) for k, (lang, text) in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {name: {r["doc_id"]: r["n"] for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("p21_entity_spans", "p22_named_entities")}
    known = lambda s: any(len(w) > 2 and w not in X.STOPWORDS for w in re.sub(r"[\W_]+", " ", s).lower().split())
    found = lambda pattern, text: {m.group() for m in re.finditer(pattern, text or "")}
    assert got["p21_entity_spans"] == {k: sum(map(known, found(X.ENTITY, text))) for k, (_, text) in enumerate(TEXTS)}
    assert got["p22_named_entities"] == {k: len(found(X.NAMED_ENTITY, text)) for k, (_, text) in enumerate(TEXTS)}
