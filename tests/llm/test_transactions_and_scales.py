"""Captures with several request and metadata records; vectors whose squares leave the range of doubles; recall with the registered parameters."""

import gzip

import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import ann, warc


def record(kind, name, to, block):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *(f"WARC-Concurrent-To: {x}" for x in to), f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def test_no_record_of_a_capture_is_lost(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\n\r\nx"
    direct = [record("response", "<r1>", [], page), record("metadata", "<m2>", ["<r1>"], b"page-id: 7\r\n"), record("metadata", "<m1>", ["<r1>"], b"page-id: 1\r\n"), record("request", "<q2>", ["<r1>"], b"GET"), record("request", "<q1>", ["<r1>"], b"GET")]
    chained = [record("metadata", "<n2>", ["<n1>"], b"page-id: 2\r\n"), record("metadata", "<n1>", ["<p1>"], b"page-id: 3\r\n"), record("request", "<p1>", ["<r2>"], b"GET"), record("request", "<p2>", ["<p1>"], b"GET"), record("response", "<r2>", [], page)]
    for name, records in (("direct", direct), ("both", direct + chained)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
        got = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, str(folder))).collect()}
        assert [m.record_id for m in got["<r1>"].metadata_records] == ["<m1>", "<m2>"] and [q.record_id for q in got["<r1>"].requests] == ["<q1>", "<q2>"]
        assert got["<r1>"].metadata.page_id == 1 and got["<r1>"].request.record_id == "<q1>"
    assert [m.page_id for m in got["<r2>"].metadata_records] == [3, 2] and [q.record_id for q in got["<r2>"].requests] == ["<p1>", "<p2>"]


def test_components_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [3e307, 3e307]), (3, [5e-324, 0.0]), (4, [1.0, -1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in got] == [(2, 1.0), (1, round(3 / 10**0.5, 12)), (3, round(0.5**0.5, 12)), (4, 0.0)]


def test_recall_with_the_registered_parameters(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 64))
    v = (centres[rng.integers(0, 60, 3000)] + 0.9 * rng.standard_normal((3000, 64))).astype(np.float32)
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(found[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / (5 * 60) >= 0.9
