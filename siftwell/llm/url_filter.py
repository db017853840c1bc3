"""URL filters on a memory-mapped sorted digest array.

A rule is a host and a path prefix. The rule file holds the sorted 64-bit xxhash
keys of all rules, their verdicts and their full strings; Spark ships it once to
each machine, where all Python workers map the same pages, so the list may be far
larger than a worker's heap. A URL probes one key for each suffix of its host
and each path length that rules have, by vectorised binary search over a batch,
and a found key counts only if the stored string is equal, so collisions do no harm.

Defined results: a null url, or one without ://, has an empty host and path; URLs
that no rule fits get `default`; the longest fitting rule (host and path
together) wins, between equally long ones that with the longer host. An empty rule
list leaves every URL to `default`; repeated rows are each judged; long URLs are judged whole; columns of pages named
like outputs are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import shared_dir, write_bytes


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _key(host: bytes, path: bytes) -> int:
    return xxhash.xxh64_intdigest(host + b"\0" + path)


def rule_file(rules: list[Rule]) -> bytes:
    """Numbers of rules and verdicts, keys, verdict numbers, offsets and strings, in this order."""
    best: dict[tuple[bytes, bytes], Rule] = {}
    for r in rules:
        best.setdefault((r.host.encode(), r.path.encode()), r)
    found = sorted((_key(h, p), h + b"\0" + p, r.verdict) for (h, p), r in best.items())
    verdicts = sorted({v for _, _, v in found})
    ends = np.cumsum([0, *(len(s) for _, s, _ in found)], dtype=np.int64)
    keys, verdict = np.array([k for k, _, _ in found], dtype=np.uint64), np.array([verdicts.index(v) for _, _, v in found], dtype=np.int64)
    return b"".join([np.array([len(found), len(verdicts)], dtype=np.int64).tobytes(), keys.tobytes(), verdict.tobytes(), ends.tobytes(), *(s for _, s, _ in found), "\n".join(verdicts).encode()])


class DigestArray:
    """The mapped rule file."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n, _ = raw[:16].view(np.int64).tolist()
        cut = [16, 16 + 8 * n, 16 + 16 * n, 24 + 24 * n]
        self.keys, self.verdict, self.ends = raw[cut[0] : cut[1]].view(np.uint64), raw[cut[1] : cut[2]].view(np.int64), raw[cut[2] : cut[3]].view(np.int64)
        self.strings = raw[cut[3] : cut[3] + int(self.ends[-1])]
        self.verdicts = bytes(raw[cut[3] + int(self.ends[-1]) :]).decode().split("\n")

    def string(self, k: int) -> bytes:
        return bytes(self.strings[self.ends[k] : self.ends[k + 1]])

    def probe(self, keys: np.ndarray):
        """(index into keys, rule) of every rule whose key is equal; equal keys of different rules are all given."""
        lo, hi = np.searchsorted(self.keys, keys, side="left"), np.searchsorted(self.keys, keys, side="right")
        n = hi - lo
        at = np.repeat(np.arange(len(keys)), n)
        return at, np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    at = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:at], rest[at:]
    stop = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def _judge(file: str, lengths: tuple[int, ...], default: str):
    def judge(batches):
        rules = DigestArray(SparkFiles.get(file))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            rows, hosts, paths = [], [], []
            for row, (host, path) in enumerate(parts):
                h, p = host.encode(), path.encode()
                ends = [n for n in lengths if n <= len(p)]
                at = 0
                while at >= 0 and h:
                    for n in ends:
                        rows.append(row)
                        hosts.append(h[at:])
                        paths.append(p[:n])
                    at = h.find(b".", at) + 1 or -1
            keys = np.fromiter((_key(h, p) for h, p in zip(hosts, paths)), dtype=np.uint64, count=len(rows))
            best: dict[int, tuple[int, int, int]] = {}
            for k, rule in zip(*(x.tolist() for x in rules.probe(keys))):
                if rules.string(rule) == hosts[k] + b"\0" + paths[k]:
                    rank = (len(hosts[k]) + len(paths[k]), len(hosts[k]), rule)
                    best[rows[k]] = max(best.get(rows[k], rank), rank)
            won = [best.get(r) for r in range(len(parts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([w and rules.string(w[2]).replace(b"\0", b"").decode() for w in won], pa.string()), pa.array([rules.verdicts[rules.verdict[w[2]]] if w else default for w in won], pa.string())], names=["_row", "host", "path", "rule", "verdict"])

    return judge


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; columns of pages of these names are replaced."""
    spark = pages.sparkSession
    data = rule_file(rules)
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:24]}"
    if name not in {x.rpartition("/")[2] for x in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(write_bytes(spark, f"{shared_dir(spark)}/{name}", data))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    lengths = tuple(sorted({len(r.path.encode()) for r in rules}))
    packed = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(url_col).cast("string").alias("_url"))
    schema = packed.select("_row").schema
    for c in ("host", "path", "rule", "verdict"):
        schema = schema.add(c, "string")
    done = packed.mapInArrow(_judge(name, lengths, default), schema)
    return done.select(*(F.col("_row").getField(c).alias(c) for c in kept), "host", "path", "rule", "verdict")
