"""The merge of backends' metrics, by hand, and its query over every event type."""

from siftwell.operators import retrieval as V
from siftwell.plans import tool_queries  # noqa: F401
from siftwell.plans.registry import QUERIES

from .test_queries import SF


def test_merge(spark):
    registered = spark.createDataFrame([(0, 0, "a"), (0, 1, "inner"), (1, 0, "b"), (1, 1, "inner"), (1, 2, "core"), (2, 0, "idle")], "position int, depth int, backend string")
    ok, bad = (True, None, 2, False, 1.0), (False, "timeout", 0, False, 3.0)
    noise, empty, lost, limited = (True, "noisy_result", 1, True, 2.0), (True, None, 0, False, 2.0), (False, "http", 0, False, 2.0), (False, "rate_limited", 0, False, 2.0)
    rows = [(0, 0, *ok), (0, 0, *bad), (0, 1, *ok), *((1, 0, *x) for x in (ok, noise, empty, lost, limited)), (1, 1, *ok), (1, 1, *ok), (1, 1, *lost), (1, 2, *empty)]
    results = spark.createDataFrame(rows, "position int, depth int, ok boolean, error_type string, n_items int, noisy boolean, latency double")
    got = {r["key"]: r["value"] for r in V.merged_metrics(registered, results).collect()}
    assert len(got) == 5 * 8  # the two inner ones share their keys
    assert (got["tool/a/requests"], got["tool/a/success_rate"], got["tool/a/timeout_rate"], got["tool/a/latency"]) == (2, 0.5, 0.5, 2)
    assert got["wrapped/tool/inner/requests"] == 3 and round(got["wrapped/tool/inner/error_rate"], 6) == 0.333333  # the last one's
    assert got["wrapped/wrapped/tool/core/empty_rate"] == 1
    assert [got[f"tool/b/{k}"] for k in ("success_rate", "empty_rate", "noise_rate", "rate_limit_rate", "error_rate", "timeout_rate")] == [0.6, 0.2, 0.2, 0.2, 0.2, 0]
    assert [got[f"tool/idle/{k}"] for k in V.METRICS] == [0] * 8


def test_every_event_type_is_merged(spark):
    types = {r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect()}
    got = {r["key"]: r["value"] for r in QUERIES["a12_merged_metrics"](spark, SF).collect()}
    assert {k.split("/")[-2] for k in got} == types and {k.split("/")[2] for k in got if k.startswith("wrapped/")} == {"click", "view", "error"}
    assert sum(v for k, v in got.items() if k.endswith("/requests") and k.startswith("tool/")) == spark.read.parquet(f"{SF}/events.parquet").count()
