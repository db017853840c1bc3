"""Quality by hierarchical empirical Bayes.

A logistic classifier on simple text measures gives each document an evidence
probability. Grouped aggregation sums it by host and path; each host's posterior is
shrunk towards the global prior and each path's towards its host's, the more the
fewer documents there are. The strengths of both priors are fitted by moments
over all sites. A document's score adds to its own log-odds those of its path,
from the other documents there alone, against the global ones.

Sites are summed with partial aggregation, so a host may hold any share of the
rows; only four sums over all sites reach the driver. Texts are read once and
never shuffled. The classifier is fitted on the `train_rows` labelled rows with the
smallest hash of their id.

Defined results: null and empty texts have measures of 0; a null host or path is
a site of its own; an empty table gives an empty result; repeated rows count each by itself; very long texts are
measured whole; a quality of exactly 0.5 is kept; columns of docs other than the id, text, host and path are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .textkernel import SPACED_LOWER, words
from .toxicity import held_out

_KIND = {"space": " \t\n\r\v\f", "mark": ".,;:!?'\"-()", "digit": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
N_MEASURES = 9


def _measures(texts) -> np.ndarray:
    """A row of bounded measures per text."""
    kind = np.full(256, 5)
    kind[[b for b in range(128) if not chr(b).isalnum()]] = 0  # other symbols
    for k, chars in enumerate(_KIND.values(), 1):
        kind[[ord(c) for c in chars]] = k
    out = []
    for lo, hi, w in words(texts, SPACED_LOWER):
        n, size, count = hi - lo, np.diff(w.offsets), np.diff(w.bounds)
        doc = np.repeat(np.arange(n), size)
        share = np.bincount(doc * 6 + kind[w.data], minlength=6 * n).reshape(n, 6) / np.maximum(size, 1)[:, None]
        odd = np.concatenate([[0], np.cumsum(kind[w.data] == 0)])
        per_word = np.bincount(w.doc, weights=odd[w.end] > odd[w.start], minlength=n) / np.maximum(count, 1)
        seen = np.bincount(np.unique(np.stack([w.doc, w.hash.view(np.int64)]), axis=1)[0], minlength=n) if len(w) else np.zeros(n)
        out.append(np.column_stack([share[:, 0], share[:, 2:5], per_word, np.minimum(size / np.maximum(count, 1), 30) / 30, seen / np.maximum(count, 1) / 1, np.log1p(count) / 12, np.log1p(size) / 15]))
    return np.concatenate(out) if out else np.zeros((0, N_MEASURES))


def _with_measures(batches):
    for batch in batches:
        m = _measures(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(m), pa.list_(pa.float64()))], names=["label", "m"])


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 8192) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression by Newton steps, outside the held-out fold."""
    usable = labels.where(~held_out("doc_id") & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    got = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_with_measures, "label int, m array<double>").toArrow()
    y = got["label"].to_numpy().astype(float)
    if not len(y):
        return np.zeros(N_MEASURES + 1)
    x = np.column_stack([np.array(got["m"].to_pylist()), np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w = w + step
    return w


def _evidence(weights: np.ndarray):
    def score(batches):
        for batch in batches:
            m = _measures(batch.column(1))
            p = 1 / (1 + np.exp(-np.clip(m @ weights[:-1] + weights[-1], -12, 12)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["_row", "evidence"])

    return score


def _strength(mean: float, between: float) -> float:
    """How many documents a prior counts for, from the variance between sites."""
    return float(np.clip(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0, 1e6))


def _logit(c):
    c = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(c / (1 - c))


def score_quality(docs: DataFrame, weights: np.ndarray, host: F.Column, path: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, quality, keep), a row for each row of docs."""
    packed = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("\0")).alias("host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("path")).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    seen = materialize(packed.mapInArrow(_evidence(weights), packed.select("_row").schema.add("evidence", "double")).select("_row.*", "evidence"), "evidence")
    paths = seen.groupBy("host", "path").agg(F.sum("evidence").alias("ps"), F.count("*").alias("pn"))
    hosts = paths.groupBy("host").agg(F.sum("ps").alias("hs"), F.sum("pn").alias("hn"))
    total = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n"), F.count("*").alias("k")).first()
    if not total["n"]:
        mean, strong_host, strong_path = 0.5, 1.0, 1.0
    else:
        mean = total["s"] / total["n"]
        noise = mean * (1 - mean)
        spread = lambda s, n, m: F.avg(F.pow(F.col(s) / F.col(n) - m, 2) - F.lit(noise) / F.col(n))
        strong_host = _strength(mean, hosts.agg(spread("hs", "hn", F.lit(mean))).first()[0])
        strong_path = _strength(mean, paths.join(hosts, "host").agg(spread("ps", "pn", F.col("hs") / F.col("hn"))).first()[0])
    sites = paths.join(hosts, "host").select("host", "path", "ps", "pn", ((F.lit(strong_host * mean) + F.col("hs")) / (strong_host + F.col("hn"))).alias("host_posterior"))
    at = seen.join(sites, ["host", "path"])
    path_posterior = (strong_path * F.col("host_posterior") + F.col("ps")) / (strong_path + F.col("pn"))
    others = (strong_path * F.col("host_posterior") + F.col("ps") - F.col("evidence")) / (strong_path + F.col("pn") - 1)
    odds = _logit(F.col("evidence")) + _logit(others) - _logit(F.lit(mean))
    return at.select("doc_id", "evidence", "host_posterior", path_posterior.alias("path_posterior"), (1 / (1 + F.exp(-odds))).alias("quality")).withColumn("keep", F.col("quality") >= 0.5)
