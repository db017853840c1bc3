import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import ann, packing, quality, toxicity, url_filter, warc
from siftwell.llm.queries import URL_RULES
from siftwell.llm.store import fresh_path


def test_warc_round_trip(spark):
    rows = [(3, "http://a/x", "<p>é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"), (1, None, "same"), (2, "http://b\nc", "same"), (5, "u", "same"), (5, "u", "same"), (7, "v", None), (6, "v", ""), (8, "w", "x" * 300000), (None, "n", "same"), (9, "tiny", "ab"), (10, "tiny", "ab")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, rid string")
    for least in (0, 3):
        path = fresh_path(spark, "warc")
        warc.write_warc(pages, path, min_bytes=least, captures_per_file=3)
        got = warc.assemble(warc.read_warc(spark, path, with_payload=True)).collect()
        first = {}
        for i, _, h in rows:
            if i is not None:
                first[h or ""] = min(first.get(h or "", i), i)
        want = []
        for i, _, h in rows:
            body = (h or "").encode()
            again = i is not None and len(body) >= least and first[h or ""] < i
            want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
        assert Counter((r.metadata.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.type, r.refers_to_page) for r in got) == Counter(want)
        assert all(r.request is not None and r.response.digest_ok is not False for r in got)
        bodies = {r.metadata.page_id: bytes(r.response.payload) for r in got if r.response.type == "response"}
        assert bodies[3] == rows[0][2].encode() and bodies[8] == rows[7][2].encode()


def test_warc_parsing_and_empty_table(spark):
    member = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(wbits=31))
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nab\r\n\r\r\n\r\n"
    assert [b for _, b in warc.parse_records(warc.gunzip(member(one) + member(one)))] == [b"ab\r\n\r"] * 2
    assert warc.gunzip(one) == one
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_warc(spark, path)).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    """Several and chained concurrent-to identifiers, payloads that hold the start of a record, files of several members."""
    import gzip

    def record(kind, name, to, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *(f"WARC-Concurrent-To: {x}" for x in to), *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"

    page = lambda body: b"HTTP/1.1 200 OK\r\n\r\n" + body
    inner = b"x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3 + bytes(range(256))
    one = [record("warcinfo", "<i>", [], b"software: x"), record("request", "<q1>", ["<r1>"], b"GET"), record("response", "<r1>", [], page(inner)), record("metadata", "<m1>", ["<q1>"], b"page-id: 1\r\n")]
    two = [record("metadata", "<m2>", ["<q2>", "<r2>"], b"page-id: 2\r\n"), record("response", "<r2>", ["<q2>"], page(b"")), record("request", "<q2>", [], b"GET"), record("revisit", "<r3>", [], b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n", "WARC-Refers-To: <r1>"), record("metadata", "<m3>", ["<m4>"], b"page-id: 3\r\n"), record("metadata", "<m4>", ["<r3>"], b"x: y\r\n"), record("metadata", "<m5>", ["<nothing>"], b"page-id: 5\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, one)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(two)))
    (tmp_path / "c.warc").write_bytes(record("response", "<r6>", [], page(b"six")))
    got = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path), with_payload=True)).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>", "<r6>"}
    assert bytes(got["<r1>"].response.payload) == inner and got["<r1>"].metadata.page_id == 1 and got["<r1>"].request.record_id == "<q1>"
    assert got["<r2>"].metadata.page_id == 2 and got["<r2>"].request.record_id == "<q2>" and got["<r2>"].response.payload_bytes == 0
    assert got["<r3>"].refers_to_page == 1 and got["<r3>"].metadata is not None and got["<r3>"].response.payload_bytes == 9
    assert bytes(got["<r6>"].response.payload) == b"six" and got["<r6>"].metadata is None


def test_no_record_is_lost_between_the_readers_blocks(spark):
    """An empty payload makes a record's end look like the start of another end."""
    rows = [(k, f"http://h/{'x' * (k % 61)}", "" if k % 2 else f"p{k}") for k in range(4000)]
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), path, min_bytes=1)
    got = warc.assemble(warc.read_warc(spark, path)).select("metadata.page_id", "response.payload_bytes", "request.record_id").collect()
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((k, len(h)) for k, _, h in rows) and all(r.record_id for r in got)


def test_pieces_are_joined_wherever_they_are_cut():
    block = lambda k: b"\r\n\r\nWARC/1." * (k % 4) + b"\r\n\r\n" * (k % 3)
    data = b"".join(b"WARC/1.1\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(block(k))) + block(k) + b"\r\n\r\n" for k in range(60))
    pieces, rng = data.split(b"\r\n\r\nWARC/1."), random.Random(3)
    for missed in (0, 0.2, 0.9):
        joined = [pieces[0]]
        for x in pieces[1:]:
            if rng.random() < missed:
                joined[-1] += b"\r\n\r\nWARC/1." + x
            else:
                joined.append(x)
        got = list(warc.joined_records([("f", x) for x in joined] + [("g", x) for x in joined]))
        assert [b for _, b in got] == [block(k) for k in range(60)] * 2


def test_one_payload_under_two_urls_and_a_large_file(spark):
    body = "".join(f"line {k}\r\n" for k in range(400_000))
    rows = [(1, "http://a/", "same"), (1, "http://b/", "same"), (2, "http://c/", "same"), (3, "http://d/", body), (4, "http://e/", body)]
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.assemble(warc.read_warc(spark, path)).collect()
    assert Counter((r.metadata.page_id, r.response.target_uri, r.response.type, r.response.payload_bytes, r.refers_to_page) for r in got) == Counter([(1, "http://a/", "response", 4, None), (1, "http://b/", "response", 4, None), (2, "http://c/", "revisit", 4, 1), (3, "http://d/", "response", len(body), None), (4, "http://e/", "revisit", len(body), 3)])
    assert len({r.response.record_id for r in got}) == 5


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://x.org/a?b#c", "http://notorg/", "https://example.org/es/1", "https://A.Example.ORG/en/1x", "https://a.example.org/en/2", "ftp://com/fr/x", "ftp://com/de/", "x://b.com?q/de/", "x://b.com/de/#://org/", "http://a..com/fr/", "http://É.com/fr/é", "http://.org/", "http://org:80/", "http://u@org/"]
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)] + [(1, "http://org/", "h", 1)], "page_id long, url string, host string, rule int")
    got = url_filter.filter_urls(pages, URL_RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = url_filter.split_url(r.url)
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.text, rule.verdict if rule else "allow")
    assert url_filter.filter_urls(pages, []).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_url_collisions_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "_key", lambda host, path: 7)
    pages = spark.createDataFrame([(1, "http://com/de/"), (2, "http://net/de/")], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    assert got == {1: "com/de/", 2: None}


def labelled(spark, n=600, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    docs, labels = [], []
    for k in range(n):
        words, bad = [rng.choice(vocab) for _ in range(rng.randint(5, 120))], k % 4 == 0
        if bad:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["Vile!", "rotten", "foul"])
        if k % 5 == 0:
            words = [w + "%%%" for w in words]
        docs.append((k, " ".join(words), "en", f"src{k % 7}", "z"))
        labels.append((k, int(k % 5 != 0), int(bad)))
    docs += [(n, None, None, None, "z"), (n + 1, "", None, "src0", "z"), (None, "foul", "en", "src1", "z"), (1, docs[1][1], "en", "src1", "z")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, toxicity string"), spark.createDataFrame(labels + [(1, 1, 0), (n, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_scores_everything(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert 0 < len(model[0]) < 3000
    got = toxicity.score_toxicity(docs, model).withColumn("h", toxicity.held_out("doc_id")).collect()
    assert len(got) == 604 and all(0 <= r.toxicity <= 1 for r in got)
    held = [r for r in got if r.h and r.doc_id < 600]
    assert np.mean([(r.toxicity >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit_toxicity(docs.limit(0), labels.limit(0))).count() == 0


def test_ftrl_is_the_plain_algorithm():
    """The fit against one that keeps its coordinates in dictionaries."""
    import math

    rng, p = random.Random(7), toxicity.FTRL(bits=8, epochs=3, l1=0.5)
    rows = [(np.array(sorted(rng.sample(range(256), 12)), np.int32), rng.randint(0, 1)) for _ in range(60)]
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(k):
        return 0.0 if abs(z[k]) <= p.l1 else -(z[k] - math.copysign(p.l1, z[k])) / ((p.beta + math.sqrt(n[k])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for at, y in rows:
            w = {k: weight(k) for k in at.tolist()}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for k in w:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / p.alpha * w[k]
                n[k] += g * g
            bias_n += g * g
            bias -= p.alpha * g / (p.beta + math.sqrt(bias_n))
    at, values, got_bias = toxicity.ftrl_fit(rows, p)
    want = {k: weight(k) for k in range(256) if weight(k)}
    assert at.tolist() == sorted(want) and np.allclose(values, [want[k] for k in sorted(want)], rtol=1e-5) and abs(got_bias - bias) < 1e-9


def test_quality_is_the_posteriors_of_plain_loops(spark):
    docs, labels = labelled(spark, n=120, seed=5)
    weights = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs.withColumn("evidence", F.lit("x")).withColumn("host", F.lit(1)), weights, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    rows = docs.collect()
    m = quality._measures(__import__("pyarrow").array([r.text for r in rows]))
    ev = [1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -12, 12))) for x in m]
    host = [r.source for r in rows]
    path = [(r.source, "/".join(v for v in (r.source, r.lang) if v is not None)) for r in rows]
    by_host, by_path = defaultdict(list), defaultdict(list)
    for e, h, q in zip(ev, host, path):
        by_host[h].append(e)
        by_path[q].append(e)
    mean = np.mean(ev)
    noise = mean * (1 - mean)
    spread = lambda sites, centre: np.mean([(np.mean(v) - centre(k)) ** 2 - noise / len(v) for k, v in sites.items()])
    strength = lambda b: float(np.clip(noise / max(b, 1e-9) - 1, 1.0, 1e6))
    sh, sp = strength(spread(by_host, lambda k: mean)), strength(spread(by_path, lambda k: np.mean(by_host[k[0]])))
    logit = lambda x: np.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    want = []
    for r, e, h, q in zip(rows, ev, host, path):
        hp = (sh * mean + sum(by_host[h])) / (sh + len(by_host[h]))
        others = (sp * hp + sum(by_path[q]) - e) / (sp + len(by_path[q]) - 1)
        want.append((-1 if r.doc_id is None else r.doc_id, round(hp, 6), round(1 / (1 + np.exp(-(logit(e) + logit(others) - logit(mean)))), 6)))
    assert sorted(want) == sorted((-1 if r.doc_id is None else r.doc_id, round(r.host_posterior, 6), round(r.quality, 6)) for r in got)


def test_quality_posteriors(spark):
    docs, labels = labelled(spark)
    weights = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, weights, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len(got) == 604 and all(0 <= x <= 1 for r in got for x in (r.evidence, r.host_posterior, r.path_posterior, r.quality))
    known = [r for r in got if r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.keep == (r.doc_id % 5 != 0) for r in known]) > 0.95
    lo, hi = min(r.evidence for r in got), max(r.evidence for r in got)
    assert all(lo <= r.host_posterior <= hi for r in got)
    assert quality.score_quality(docs.limit(0), weights, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [(k, "x", "big" if k < 400 else f"s{k}") for k in range(440)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = np.zeros(quality.N_MEASURES + 1)
    got = quality.score_quality(docs, w, F.col("source"), F.col("source")).collect()
    assert all(abs(r.quality - 0.5) < 1e-6 for r in got)


def test_packing_keeps_every_rule(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, "src0", "src0", "src0", f"s{rng.randint(1, 90)}"]), " ".join(f"w{rng.randint(0, 9)}" if k % 6 else "same" for _ in range(rng.choice([1, 7, 30, 99, 100, 260, 300]) if k % 6 else 9)), 1) for k in range(700)]
    rows += [(700, "a", None, 1), (701, "a", "", 1), (702, "b", "dup dup", 1), (702, "b", "dup dup", 1), (None, "c", "x y", 1)]
    got = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, source string, text string, bin_id int"), capacity=100, shard_rows=300).collect()
    size = Counter()
    for i, _, t, _ in rows:
        size[i] += len((t or "").split())
    packed, bins, by_bin = Counter(), Counter(), defaultdict(list)
    source, text = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    for r in got:
        packed[r.doc_id] += r.n_words
        if r.bin_id is None:
            assert r.n_words == 0
            continue
        bins[r.bin_id] += r.n_words
        by_bin[r.bin_id].append(r)
    assert packed == size and max(bins.values()) <= 100
    for own in by_bin.values():
        assert len(own) == 1 or len({source[r.doc_id] for r in own if source[r.doc_id]}) == sum(source[r.doc_id] is not None for r in own)
        assert len(own) == len({text[r.doc_id] for r in own})
        spans = sorted((r.bin_offset, r.bin_offset + r.n_words) for r in own)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
    assert packing.best_fit_pack(spark.createDataFrame(rows[:1], "doc_id long, source string, text string, b int").limit(0)).count() == 0


@pytest.mark.parametrize("bits", [62, 2])
def test_best_fit_takes_the_tightest_compatible_bin(monkeypatch, bits):
    monkeypatch.setattr(packing, "_BITS", bits)
    rng = random.Random(6)
    bins, plain = packing.BestFit(50, [f"k{k}" for k in range(8)]), []
    for _ in range(400):
        size, keys = rng.randint(1, 40), tuple({f"k{rng.randint(0, 7)}", f"k{rng.randint(0, 20)}"})
        at, before = bins.place(size, keys)
        fits = [b for b, (used, held) in enumerate(plain) if used + size <= 50 and not held & set(keys)]
        if fits:
            assert plain[at][0] == before == max(plain[b][0] for b in fits) and at in fits
            plain[at] = (before + size, plain[at][1] | set(keys))
        else:
            assert at == len(plain) and before == 0
            plain.append((size, set(keys)))


@pytest.mark.parametrize(("hashes", "probes"), [(1, 4), (2, 24)])
def test_neighbours(spark, hashes, probes):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 10))
    v[50:150] = v[50]
    v[200:230] = v[200:230] * 0 + v[199] * 2
    rows = [(k, x.tolist(), "q") for k, x in enumerate(v)]
    rows += [(400, None, "q"), (401, [0.0] * 10, "q"), (402, [float("nan")] + [1.0] * 9, "q"), (403, [None] + [1.0] * 9, "q"), (404, [float("inf")] + [1.0] * 9, "q"), (405, [1.0, 2.0], "q"), (406, [], "q")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 10 == 0, tables=8, probes=probes, hashes=hashes, query_block=16).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    assert set(got) == set(range(0, 400, 10))
    for q, rows in got.items():
        rows.sort()
        s = u @ u[q]
        order = sorted((k for k in range(400) if k != q), key=lambda k: (-round(s[k], 9), k))[:5]
        hit += len({x for _, x, _ in rows} & set(order))
        assert [n for n, _, _ in rows] == [1, 2, 3, 4, 5]
        assert all(abs(s[x] - y) < 1e-12 for _, x, y in rows)
        assert [x for _, x, _ in rows] == [x for _, x, _ in sorted(rows, key=lambda r: (-r[2], r[1]))]
    assert hit >= 0.9 * 5 * len(got)


def test_neighbours_of_few_or_no_vectors(spark):
    rows = [(k, [1.0, float(k)], 1) for k in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int")
    got = ann.nearest(frame, F.col("vec_id") % 2 == 0, tables=1, probes=1).collect()
    assert Counter(r.query_id for r in got) == {0: 3, 2: 3}
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_each_length_has_its_own_neighbours(spark):
    rows = [(k, [1.0, float(k)]) for k in range(0, 8, 2)] + [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 2.0]), (102, [0.0, 0.0, 1.0]), (104, [5.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, k=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[100] == [101, 102] and got[102] == [100, 101] and 104 not in got
    assert got[2] == [7, 4, 6] and len(got) == 6
