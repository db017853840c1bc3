"""Search backends by name: each maps queries to results, and may be wrapped by fault injection."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval as V


class Retriever(Protocol):
    """Gives results (query_id, ok, error_type, n_items, noisy) for queries (query_id, query)."""

    name: str

    def search(self, queries: DataFrame) -> DataFrame: ...


@dataclass
class Corpus:
    """BM25 over a document table."""

    documents: DataFrame
    top_k: int = 3
    name: str = "local_bm25"

    def search(self, queries: DataFrame) -> DataFrame:
        asked = queries.select(F.col("query_id").alias("item_id"), F.col("query").alias("text"))
        found = V.search_status(asked, V.bm25(self.documents, asked, self.top_k))
        return found.withColumn("noisy", F.lit(False))


@dataclass
class Fixture:
    """A table of known queries."""

    pairs: DataFrame
    name: str = "mock"

    def search(self, queries: DataFrame) -> DataFrame:
        return V.mock_lookup(queries, self.pairs).select("query_id", "ok", F.lit(None).cast("string").alias("error_type"), "n_items", F.lit(False).alias("noisy"))


@dataclass
class Faulty:
    """Another backend with injected failures; keeps its name."""

    inner: Retriever
    probabilities: dict[str, float]
    seed: int = 0

    @property
    def name(self) -> str:
        return self.inner.name

    def search(self, queries: DataFrame) -> DataFrame:
        drawn = V.draw_failures(queries, self.probabilities, self.seed, "query_id").select("query_id", "failure")
        got = self.inner.search(queries).join(drawn, "query_id").withColumn("_r", V.failure_result(F.col("failure")))
        hit = F.col("failure").isNotNull()
        return got.select("query_id", F.when(hit, F.col("_r.ok")).otherwise(F.col("ok")).alias("ok"), F.when(hit, F.col("_r.error_type")).otherwise(F.col("error_type")).alias("error_type"), F.when(hit, F.when(F.col("failure") == "noise", 1).otherwise(0)).otherwise(F.col("n_items")).alias("n_items"), (F.col("noisy") | _noise(hit)).alias("noisy"))


def _noise(hit):
    return F.coalesce(hit & (F.col("failure") == "noise"), F.lit(False))


def build(name: str, probabilities: dict[str, float] | None = None, seed: int = 0, **options) -> Retriever:
    """A backend by name, wrapped only where some failure is possible."""
    kinds = {"local_bm25": Corpus, "mock": Fixture}
    if name not in kinds:
        raise ValueError(f"no such backend: {name}")
    made = kinds[name](**options)
    return Faulty(made, probabilities, seed) if any((probabilities or {}).values()) else made


def tool_records(queries: DataFrame, backend: Retriever) -> DataFrame:
    """Results in the shape of trajectories: one search each, without a score."""
    r = backend.search(queries)
    return r.join(queries, "query_id").select("query_id", F.col("query").alias("question"), F.lit(backend.name).alias("data_source"), F.lit(None).cast("double").alias("reward"), F.lit(1).alias("search_calls"), F.when(r["ok"], 0).otherwise(1).alias("tool_failures"), "ok", "error_type", "n_items", "noisy")
