"""The llm subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontaminate import decontaminate
from .media import decode_media, encode_media
from .ngram_jaccard import ngram_jaccard_components
from .packing import best_fit_pack
from .periodic_runs import periodic_runs
from .quality import fit_quality, score_quality
from .store import drop_at_exit, fresh_path
from .substring_dedup import substring_dedup
from .tiered_search import tiered_search
from .token_counts import count_tokens
from .toxicity import fit_toxicity, held_out, score_toxicity
from .url_filter import Rule, filter_urls
from .warc import assemble, read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, window=13, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, min_bytes=0)
    drop_at_exit(spark, path)
    found = assemble(read_warc(spark, path))
    return found.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no URL: the source stands for the host, source and language for the path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    weights = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, weights, F.col("source"), F.concat_ws("/", "source", "lang"))


#: The rules of the URL filter query.
URL_RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), short_items=True)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.coalesce(F.try_element_at("items", F.lit(1)), F.lit(-1)).alias("first_item_id"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_jaccard_components(docs, size=3, percent=90)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op11_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    padded = docs.withColumn("payload", F.expr("rpad(raw, int(greatest(64, 64 * ceil(n_bytes / 64))), X'00')")).drop("raw")
    read = decode_media(encode_media(padded, "payload"), "media")
    shots = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["first_frame"].cast("string"), c["end_frame"].cast("string"))), " ")
    feature = F.concat_ws(";", F.concat_ws("x", F.col("frames").cast("string"), F.col("width").cast("string"), F.col("height").cast("string")), F.concat(F.size("clips").cast("string"), F.lit(" shots")), shots)
    tail = F.crc32(F.expr("substring(payload, -64, 64)"))
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def planted_repetition(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten, the numbers of the words that make the end of a document of n words periodic."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g, at = h // 10, np.arange(n)
    a = g % n
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), least=12, remap=planted_repetition)
    longest = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("_best", longest)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_toxicity, op4_quality_classifier, op5_url_filters, op6_token_counts, op7_best_fit_packing, op8_decontamination, op9_ngram_jaccard, op10_nearest_neighbours, op11_media_columns, op12_periodic_runs, op13_ranked_search)}

_OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS digest FROM d)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM b
"""

_OP5_SQL = """
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

_OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM starts),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p + o AS q FROM (SELECT doc_id, p FROM win JOIN f USING (k) WHERE doc_id > first) CROSS JOIN range(13) t(o)),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM w),
kept AS (SELECT each.doc_id, count(gone.q) AS n_removed, string_agg(word, ' ' ORDER BY each.q) FILTER (gone.q IS NULL) AS kept FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.q = each.q GROUP BY each.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Two substitutions in 13 words leave four words in a row unchanged, so four-word sequences find all diagonals. No item has under 13 words.
_OP8_SQL = rf"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark),
dg AS (SELECT id, p, array_to_string(ws[p:p + 3], ' ') AS k FROM (SELECT id, ws, unnest(range(1, len(ws) - 2)) AS p FROM d WHERE len(ws) >= 13)),
bg AS (SELECT id, p, array_to_string(ws[p:p + 3], ' ') AS k FROM (SELECT id, ws, unnest(range(1, len(ws) - 2)) AS p FROM b WHERE len(ws) >= 13)),
diag AS (SELECT DISTINCT dg.id AS doc_id, bg.id AS item_id, dg.p - bg.p AS shift FROM dg JOIN bg USING (k)),
places AS (SELECT doc_id, item_id, shift, unnest(range(greatest(1, 1 - shift), 1 + least(len(b.ws), len(d.ws) - shift))) AS q, d.ws AS dw, b.ws AS bw FROM diag JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
same AS (SELECT doc_id, item_id, shift, q, (dw[q + shift] = bw[q])::INT AS e FROM places),
sums AS (SELECT doc_id, item_id, sum(e) OVER w AS agree, count(*) OVER w AS n FROM same WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY q ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
hit AS (SELECT DISTINCT doc_id, item_id FROM sums WHERE n = 13 AND agree >= 11)
SELECT d.id AS doc_id, count(item_id) > 0 AS contaminated, count(item_id) AS n_items, coalesce(min(item_id), -1) AS first_item_id FROM d LEFT JOIN hit ON hit.doc_id = d.id GROUP BY d.id
"""

_OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda p: array_to_string(ws[p:p + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS k FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(b), w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = w.doc_id GROUP BY w.doc_id, n.n
"""

_OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op13_ranked_search": _OP13_SQL, "op1_substring_dedup": _OP1_SQL, "op2_warc": _OP2_SQL, "op5_url_filters": _OP5_SQL, "op8_decontamination": _OP8_SQL, "op9_ngram_jaccard": _OP9_SQL}
