"""WARC archives: writing captures, and assembling transactions from the records read back.

A capture is written as three records: the request, the response (or, for a payload
that another capture holds already, a revisit of it) and metadata. Request and metadata name the response
in WARC-Concurrent-To. Reading parses records by their Content-Length, and assembly groups
them by that identifier into one nested row per capture. In archives of other writers a record may name
several others, or one that itself names the response: records that reach no response directly go to that of
the connected component of all identifiers. A capture keeps all its requests and metadata records.

Archives are written by Spark's text writer, so they land in any file system that
Spark reaches, tasks that are lost leave nothing behind, and files hold at most
`captures_per_file` captures; tasks are dealt about 64 MB of payload. Compressed archives are read as a stream,
cut at the starts of records by Spark's text reader and put together again where a payload holds such a
start, so a reader holds a batch of records, however large a file is; archives that are not compressed are
read whole. Payloads are shuffled once when writing (to meet
the decisions on revisits) and never when reading.

Defined results: a null html is an empty payload; captures that share page_id, url and payload
are each emitted; a null page_id is written and comes back as null, is never revisited and is always a
response; of captures with the smallest page_id of a payload under several URLs all are responses, and revisits refer to
the least URL; very long payloads are written and read whole; extra columns are ignored, whatever their names; an empty
table gives an empty result; records that reach no response make no row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialize, shuffle_partitions, text_bytes

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EOL = "\r\n"
#: The end of one record and the start of the next.
_CUT = "\r\n\r\nWARC/1."
_RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, payload_bytes long, digest_ok boolean, page_id long, payload binary"
_RECORD_PA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("page_id", pa.int64()), ("payload", pa.binary())])


def _main() -> Column:
    return F.col("type").isin("response", "revisit")


def base32_of(digits: Column) -> Column:
    """Upper-case base32 of the forty hex digits of a SHA-1, in the JVM: five digits make four characters."""
    parts = [F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    letter = lambda v: F.substr(F.lit(_BASE32), v + 1, F.lit(1))
    return F.concat(*(letter(F.shiftright(p, s).bitwiseAND(31)) for p in parts for s in (15, 10, 5, 0)))


def _urn(kind: str, *cols: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column, tail: str = _EOL * 2) -> Column:
    """A record as text; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)) for name, value in headers]
    return F.concat(F.lit(f"WARC/1.1{_EOL}"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_EOL * 2), block, F.lit(tail))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", captures_per_file: int = 1500) -> None:
    """Write page_id, url and html as gzip archives in the folder path."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\r\n]", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    if (tasks := text_bytes(page, "html") >> 26) > shuffle_partitions(pages.sparkSession):
        page = page.repartition(tasks, "page_id", "sha")
    large = page.where("page_id is not null").where(F.octet_length("html") >= min_bytes).select("page_id", "sha", "url")
    first = large.groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    # dealt anew, so that Spark can split a payload that very many pages hold
    again = large.join(first.hint("rebalance"), "sha").where("page_id > first.page_id").select("page_id", "sha", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")).distinct()
    row = page.join(again, ["page_id", "sha"], "left").withColumns({"rid": _urn("response", "page_id", "url", "sha"), "ref": F.when(F.col("first").isNotNull(), _urn("response", "first", "first_url", "sha"))})
    stamp, uri = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request", "page_id", "url", "sha")), ("WARC-Concurrent-To", F.col("rid")), stamp, uri, ("Content-Type", F.lit("application/http; msgtype=request"))], F.lit(f"GET / HTTP/1.1{_EOL * 2}"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.octet_length("html").cast("string"), F.lit(_EOL * 2))
    response = _record([("WARC-Type", F.when(F.col("ref").isNull(), "response").otherwise("revisit")), ("WARC-Record-ID", F.col("rid")), stamp, uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of(F.col("sha")))), ("WARC-Refers-To", F.col("ref")), ("WARC-Profile", F.when(F.col("ref").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))], F.when(F.col("ref").isNull(), F.concat(head, "html")).otherwise(head))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", "page_id", "url", "sha")), ("WARC-Concurrent-To", F.col("rid")), stamp, uri, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_EOL)), tail="\r\n\r")
    # the writer ends each row with a line feed, which is the last byte of a record
    row.select(F.concat(request, response, metadata).alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").option("maxRecordsPerFile", captures_per_file).text(path)


def _headers(lines: list[str]) -> dict:
    """Headers by lower-case name; those of WARC-Concurrent-To as a list."""
    out = {"warc-concurrent-to": []}
    for k, _, v in (x.partition(":") for x in lines):
        if (k := k.strip().lower()) == "warc-concurrent-to":
            out[k].append(v.strip())
        else:
            out[k] = v.strip()
    return out


def parse_records(data: bytes):
    """(headers with lower-case names, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode(errors="replace").split(_EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers, start = _headers(lines[1:]), end + 4
        stop = start + int(headers["content-length"])
        yield headers, data[start:stop]
        at = stop + 4


def joined_records(pieces):
    """(headers, block) of each record, from (file, piece) pairs: the files' bytes, with _CUT taken out at some of its places."""
    file, held, need, skip = None, bytearray(), 0, 0
    for name, piece in pieces:
        if name != file:
            if held:
                raise ValueError(f"a record of {file} has no end")
            file, held, need, skip = name, bytearray(piece), 0, 0
        else:
            held += (_CUT.encode() + piece)[skip:]
        at = skip = 0
        while len(held) > max(at, need - 1):
            if held[at : at + 5] != b"WARC/":
                raise ValueError(f"no WARC record where one of {file} starts")
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            headers = _headers(held[at:end].decode(errors="replace").split(_EOL)[1:])
            need = end + 4 + int(headers["content-length"])
            if len(held) < need:
                break
            yield headers, bytes(held[end + 4 : need])
            # the record's own end may come with the next piece
            at, skip, need = min(need + 4, len(held)), max(0, need + 4 - len(held)), 0
        del held[:at]
        need = max(0, need - at)
    if held:
        raise ValueError(f"a record of {file} has no end")


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file; other data as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) if out else data


def _row(h: dict, block: bytes, with_payload: bool) -> tuple:
    kind, digest, size, ok, page, body = h["warc-type"], None, None, None, None, None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        said = h.get("warc-payload-digest", "").partition(":")[2]
        if kind == "response":
            digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
            ok = said in ("", digest)
        else:
            fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
            digest, size, body = said, int(fields.get(b"content-length", 0)), None
    elif kind == "metadata":
        fields = dict(x.split(": ", 1) for x in block.decode(errors="replace").split(_EOL) if ": " in x)
        page = int(fields["page-id"]) if fields.get("page-id") else None
    return (h["warc-record-id"], kind, h["warc-concurrent-to"], h.get("warc-refers-to"), h.get("warc-target-uri"), digest, size, ok, page, body if with_payload else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _RECORD_PA)] if rows else [pa.array([], f.type) for f in _RECORD_PA], schema=_RECORD_PA)


def _whole_parser(with_payload: bool):
    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                yield _batch([_row(h, block, with_payload) for h, block in parse_records(gunzip(content.as_buffer().to_pybytes()))])

    return parse


def _stream_parser(with_payload: bool, most: int = 1024):
    def parse(batches):
        pieces, rows = ((f, x) for b in batches for f, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), []
        for h, block in joined_records(pieces):
            rows.append(_row(h, block, with_payload))
            if len(rows) == most:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return parse


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in the folder path: *.gz as streams, *.warc whole."""
    pieces = spark.read.option("lineSep", _CUT).option("pathGlobFilter", "*.gz").text(path).select("_metadata.file_path", F.col("value").cast("binary"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select("content")
    return pieces.mapInArrow(_stream_parser(with_payload), _RECORD).union(files.mapInArrow(_whole_parser(with_payload), _RECORD))


def _keyed(records: DataFrame, key: Column) -> DataFrame:
    """A row for each key: its response, all requests and all metadata records by record id, the first of each, and the number of responses."""
    part = lambda *kinds: F.when(F.col("type").isin(*kinds), F.struct("record_id", "type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "digest_ok", "page_id", "payload"))
    names = F.size(F.coalesce("concurrent_to", F.array()))
    odd = F.bool_or((names > 1) | (_main() & (names > 0)))
    every = lambda kind: F.array_sort(F.collect_list(part(kind)))
    met = records.groupBy(key.alias("capture_id")).agg(F.any_value(part("response", "revisit"), True).alias("response"), every("request").alias("requests"), every("metadata").alias("metadata_records"), F.count_if(_main()).alias("n"), odd.alias("odd"))
    return met.withColumns({"request": F.get("requests", F.lit(0)), "metadata": F.get("metadata_records", F.lit(0))})


def _homes(records: DataFrame) -> DataFrame:
    """(record_id, home): the response of each other record, directly named or reached through other records."""
    ids = materialize(records.select("record_id", _main().alias("main"), "concurrent_to"), "records")
    edges = ids.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    mains = ids.where("main").select(F.col("record_id").alias("id")).distinct()
    direct = edges.join(mains, F.col("b") == F.col("id")).groupBy("a").agg(F.min("b").alias("direct"))
    linked = materialize(connected_components(edges), "components")
    least = linked.join(mains, "id").groupBy("component").agg(F.min("id").alias("least"))
    others = ids.where("not main").select("record_id").distinct()
    reached = linked.join(least.hint("rebalance"), "component").select(F.col("id").alias("record_id"), "least")
    return others.join(direct.withColumnRenamed("a", "record_id"), "record_id", "left").join(reached, "record_id", "left").select("record_id", F.coalesce("direct", "least").alias("home"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), requests and metadata_records (all that belong to it, by record id), request and
    metadata (the first of each), and the page that a revisit refers to."""
    key = F.when(_main(), F.col("record_id")).otherwise(F.coalesce(F.get("concurrent_to", F.lit(0)), "record_id"))
    met = materialize(_keyed(records, key), "captures")
    if met.where("odd or n = 0").limit(1).count():
        homed = records.join(_homes(records), "record_id", "left")
        met = materialize(_keyed(homed, F.when(_main(), F.col("record_id")).otherwise(F.coalesce("home", "record_id"))), "captures")
    each = met.where("response is not null").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n", "copy", "odd")
    # dealt anew, so that Spark can split a response that very many revisit; who refers to nothing gets a key that nothing has
    target = met.where("response.type = 'response'").select(F.col("capture_id").alias("_to"), F.col("metadata.page_id").alias("refers_to_page")).hint("rebalance")
    return each.withColumn("_to", F.coalesce("response.refers_to", F.concat(F.lit("none "), "capture_id"))).join(target, "_to", "left").drop("_to")
