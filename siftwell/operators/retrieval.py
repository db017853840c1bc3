"""Lexical retrieval and search tools as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import scratch
from . import bm25_index


def postings(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf, dl), and a row without a term for a document without any; only of the terms given, if any are."""
    words = corpus.select(F.col(id_col).alias("doc_id"), X.tokenize(F.coalesce(text_col, F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens"))
    each = words.select("doc_id", "dl", F.explode_outer("tokens").alias("term"))
    if terms is not None:
        each = each.join(terms, "term", "left_semi")
    return each.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of n_docs and avg_len, documents without tokens included."""
    return corpus.select(F.size(X.tokenize(F.coalesce(text_col, F.lit("")))).alias("dl")).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_len"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def bm25(corpus: DataFrame, queries: DataFrame, top_k: int = 3, k1: float = 1.5, b: float = 0.75, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) of the best documents of each query; repeated query words count again.

    The corpus is tokenised once, and only words that some query has are kept. Many searches over one corpus are better done over an
    index written once (`bm25_index.write_index` and `search`).
    """
    asked = bm25_index.ask(queries, query_id, query_text)
    known = bm25_index.write_tokens(corpus, scratch(corpus.sparkSession, "bm25"), asked.select("term"), id_col, text_col)
    return bm25_index.search_once(known, asked, top_k, k1, b)


def search_status(queries: DataFrame, hits: DataFrame, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, ok, error_type, n_items); no token is an error, no hit an empty success."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_items"))
    found = queries.select(F.col(query_id).alias("query_id"), (F.size(X.tokenize(F.coalesce(query_text, F.lit("")))) > 0).alias("ok"))
    return found.join(n, "query_id", "left").select("query_id", "ok", F.when(~F.col("ok"), "empty_query").alias("error_type"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def mock_lookup(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Answers of a fixture table by normalised query; a miss is an empty success.

    queries: query_id, query; pairs: query, n_items.
    """
    known = pairs.select(X.normalize_query(F.col("query")).alias("k"), F.col("n_items").alias("_n")).groupBy("k").agg(F.max("_n").alias("_n"))
    return queries.withColumn("k", X.normalize_query(F.col("query"))).join(known, "k", "left").select("query_id", "query", F.lit(True).alias("ok"), F.coalesce("_n", F.lit(0)).alias("n_items"), F.col("_n").isNull().alias("empty"))


def route_calls(calls: DataFrame, tools: list[str]) -> DataFrame:
    """calls with error_type: unknown_tool, invalid_arguments or null. calls: tool, query."""
    bad = F.col("query").isNull() | (X.squeeze(F.col("query")) == "")
    return calls.withColumn("error_type", F.when(~F.coalesce(F.col("tool").isin(tools), F.lit(False)), "unknown_tool").when(bad, "invalid_arguments"))


def draw_failures(calls: DataFrame, probabilities: dict[str, float], seed: int, key: str) -> DataFrame:
    """Calls with failure: one uniform draw each against cumulative probabilities, in the order given; null for none."""
    if any(p < 0 for p in probabilities.values()) or sum(probabilities.values()) > 1:
        raise ValueError("probabilities must be non-negative and sum to one at most")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    drawn, total, rule = calls.withColumn("u", u), 0.0, None
    for name, p in probabilities.items():
        total += p
        rule = (F.when if rule is None else rule.when)(F.col("u") < total, name)
    return drawn.withColumn("failure", rule if rule is not None else F.lit(None).cast("string"))


def failure_result(failure) -> F.Column:
    """Struct of ok, status and error_type that an injected failure gives."""
    return F.struct((failure.isNull() | failure.isin("empty", "noise")).alias("ok"), F.when(failure == "rate_limited", 429).cast("int").alias("status"), F.when(failure.isin("timeout", "rate_limited"), failure).alias("error_type"))


def search_stats(results: DataFrame, by: list[str]) -> DataFrame:
    """Rates and mean latency of results: ok, n_items, noisy, error_type, latency."""
    n = F.greatest(F.count("*"), F.lit(1))
    rate = lambda c, name: (F.count_if(c) / n).alias(name)
    bad = ~F.col("ok")
    kind = F.coalesce("error_type", F.lit(""))
    return results.groupBy(*by).agg(F.count("*").alias("count"), rate(F.col("ok"), "success_rate"), rate(F.col("ok") & (F.col("n_items") == 0), "empty_rate"), rate(F.col("ok") & F.col("noisy"), "noisy_rate"), rate(bad & (kind == "timeout"), "timeout_rate"), rate(bad & (kind == "rate_limited"), "rate_limited_rate"), rate(bad & ~kind.isin("timeout", "rate_limited"), "error_rate"), (F.sum("latency") / n).alias("mean_latency"))


#: Names of metrics, and the columns of search_stats that hold them.
METRICS = {"requests": "count", "success_rate": "success_rate", "empty_rate": "empty_rate", "timeout_rate": "timeout_rate", "rate_limit_rate": "rate_limited_rate", "noise_rate": "noisy_rate", "error_rate": "error_rate", "latency": "mean_latency"}


def merged_metrics(registered: DataFrame, results: DataFrame) -> DataFrame:
    """(key, value): the metrics of all registered backends and of those they wrap, each level with another wrapped/ before it.

    registered: position, depth (0, 1 for the backend it wraps, ...), backend; results: position, depth and the columns
    of search_stats. Backends without results count 0; of equal keys the one of the last position stays.
    """
    at = ["position", "depth"]
    stats = search_stats(results, at).select(*at, *(F.col(c).cast("double").alias(k) for k, c in METRICS.items()))
    each = registered.select(*at, "backend").join(stats, at, "left").fillna(0.0, list(METRICS)).unpivot([*at, "backend"], list(METRICS), "name", "value")
    key = F.concat(F.repeat(F.lit("wrapped/"), F.col("depth")), F.lit("tool/"), "backend", F.lit("/"), "name")
    return each.groupBy(key.alias("key")).agg(F.max_by("value", "position").alias("value"))
