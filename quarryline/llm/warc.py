"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response record holds a captured HTTP message.  From each one ``derive`` makes
two records of the WARC 1.1 format: ``metadata`` (the envelope as JSON: HTTP
status and all headers in their order, title, number of links) and ``conversion`` (the text of the
page).  Both carry the response's id in WARC-Refers-To, its target URI and date,
and its payload digest as the source's; each has a block digest of its own.

DataFrame functions only; nothing is shuffled.  A record is one row.

Defined results: a null page body is an empty payload; a null url is an empty
target URI; a page without a title or text gives empty ones; a block without the
blank line after its headers is all headers and has an empty payload.  A record id
is made of page id and url, so equal rows give equal records, each kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once

CRLF = "\r\n"
DATE = "2026-01-01T00:00:00Z"

# The commonest character references, ampersand last; the others come after a look for any.
REFERENCES = [
    ("&lt;?", "<"),
    ("&gt;?", ">"),
    ("&quot;?", '"'),
    ("&(?:apos|#39|#x27);", "'"),
    ("&(?:nbsp|#160|#xA0);?", " "),
    ("&(?:copy|#169);?", "©"),
    ("&(?:middot|#183);?", "·"),
    ("&amp;?", "&"),
]
_NAMED = [x for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))]
DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
_DROPPED = f"(?is)<(?:{DROPPED.removeprefix('(?is)<').replace('|<', '|')})"  # the same; most places fail at its first character
BREAKS = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|nav|article|section|footer|header|table|tr|br|form|body|html)\b[^>]*>"
TAGS = r"<[A-Za-z/!][^>]*>"
SPACES = r"[\x20\x09-\x0D]+"
RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"  # those of SPACES that aren't one space already


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _sha1(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.encode(text, "UTF-8")))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as response records: id, target URI, date and the HTTP message as block."""
    html = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(CRLF + CRLF),
    )
    uri = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        "page_id",
        "url",
        _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(head, html).alias("block"),
    )


def _dereferenced(text: Column) -> Column:
    """Every other reference, by name or number; what is none stays as it is."""
    parts = F.regexp_extract_all(text, F.lit("(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]{1,9};|[^&]+|&)"), 1)

    def numbered(x: Column, code: Column) -> Column:
        shown = F.when((code < 0x10000) & ~code.between(0xD800, 0xDFFF) & (code > 0), F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))
        high = code - 0x10000
        pair = F.concat(F.lpad(F.hex(F.lit(0xD800) + F.floor(high / 1024)), 4, "0"), F.lpad(F.hex(F.lit(0xDC00) + high % 1024), 4, "0"))
        wide = F.when((code >= 0x10000) & (code <= 0x10FFFF), F.decode(F.unhex(pair), "UTF-16BE"))
        return F.coalesce(shown, wide, x)

    def one(x: Column) -> Column:
        code = F.when(x.rlike("^&#[0-9]"), F.regexp_extract(x, "([0-9]+)", 1).cast("int")).otherwise(F.conv(F.regexp_extract(x, "^&#[xX](.*);$", 1), 16, 10).cast("int"))
        named = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, _NAMED)), F.regexp_extract(x, "^&(.*);$", 1)), x)
        return F.when(~F.startswith(x, F.lit("&")), x).when(F.startswith(x, F.lit("&#")), once(code, lambda c: numbered(x, c))).otherwise(named)

    return F.when(text.rlike("&#|&[A-Za-z]"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _replaced(text: Column, pattern: str, put: str) -> Column:
    """``regexp_replace`` of one of ``REFERENCES`` in texts that have a beginning of it."""
    starts = pattern[1:].rstrip("?").rstrip(";").removeprefix("(?:").removesuffix(")").split("|")
    return once(text, lambda t: F.when(reduce(or_, [F.contains(t, F.lit(f"&{x}")) for x in starts]), F.regexp_replace(t, pattern, put)).otherwise(t))


def plain_text(html: Column) -> Column:
    """The visible text: a line for each block, white space runs as one space."""
    text = F.regexp_replace(html, _DROPPED, " ")
    text = F.regexp_replace(F.regexp_replace(text, RUNS, " "), BREAKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    for pattern, put in REFERENCES[:-1]:
        text = _replaced(text, pattern, put)
    text = _replaced(once(text, _dereferenced), *REFERENCES[-1])
    text = F.regexp_replace(text, " *\n[ \n]*", "\n")
    return F.trim(text, F.lit(" \n"))


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: kind ``metadata`` and kind ``conversion``.

    ``header`` is the WARC header block; ``content`` the record's block.
    """
    at = F.instr("block", CRLF + CRLF)
    split = records.withColumn("http", F.when(at > 0, F.expr("left(block, instr(block, '\r\n\r\n') - 1)")).otherwise(F.col("block"))).withColumn(
        "payload", F.when(at > 0, F.expr("substring(block, instr(block, '\r\n\r\n') + 4)")).otherwise(F.lit(""))
    )
    payload = F.col("payload")
    named = F.filter(F.slice(F.split("http", "\r?\n"), 2, 10_000), lambda x: F.contains(x, F.lit(":")))
    headers = F.transform(named, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    facts = split.select(
        "page_id",
        "url",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        _sha1(payload).alias("payload_digest"),
        F.to_json(
            F.struct(
                F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]+)", 1).alias("status"),
                F.regexp_extract("http", r"(?i)\ncontent-type: *([^\r\n]*)", 1).alias("content_type"),
                F.regexp_extract("http", r"(?i)\ncontent-length: *([0-9]*)", 1).alias("content_length"),
                headers.alias("headers"),
                F.octet_length(payload).alias("payload_bytes"),
                F.trim(F.regexp_extract(payload, r"(?is)<title[^>]*>([^<]*)", 1)).alias("title"),
                (F.size(F.split(payload, r"(?i)<a\s[^>]*href")) - 1).alias("links"),
            )
        ).alias("about"),
        plain_text(payload).alias("text"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/json").alias("content_type"), F.col("about").alias("content")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("content")),
    )
    out = facts.select("page_id", "url", "refers_to", "target_uri", "warc_date", "payload_digest", F.explode(kinds).alias("r")).select(
        "page_id", "url", "refers_to", "target_uri", "warc_date", "payload_digest", "r.kind", "r.content_type", "r.content"
    )
    out = out.select(
        "*",
        _urn(F.col("kind"), F.col("refers_to")).alias("record_id"),
        _sha1(F.col("content")).alias("block_digest"),
        F.octet_length("content").cast("long").alias("content_length"),
    )
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Date: "), F.col("warc_date")),
        F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), F.col("payload_digest")),
        F.concat(F.lit("Content-Type: "), F.col("content_type")),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    return out.withColumn("header", F.concat_ws(CRLF, *lines))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files at ``path``, by Spark's text writer: a record ends in two line ends."""
    text = records.select(F.concat("header", F.lit(CRLF + CRLF), "content").alias("value"))
    text.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def _records(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while (start := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        head = data[start:end].decode("utf-8", "replace")
        size = next((int(x.split(":", 1)[1]) for x in head.split(CRLF) if x.lower().startswith("content-length:")), 0)
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped, as ``kind, record_id, ..., header, block``.

    A task takes one file at a time.
    """

    def parse(batches):
        import gzip

        import pandas as pd

        names = {"kind": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "warc_date": "warc-date"}
        for files in batches:
            for data in files["content"]:
                rows = []
                for head, block in _records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    has = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split(CRLF)[1:])}
                    rows.append({k: has.get(v) for k, v in names.items()} | {"header": head, "block": block.decode("utf-8", "replace")})
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    schema = "kind string, record_id string, refers_to string, target_uri string, warc_date string, header string, block string"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def op2_warc_derivatives(spark, sf_dir):
    """Every page as a response, and from each its metadata and conversion record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return derive(responses(pages)).drop("target_uri", "warc_date")


def _sql() -> str:
    def q(s):
        return "'" + s.replace("'", "''") + "'"

    text = f"regexp_replace(payload, {q(DROPPED)}, ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {q(SPACES)}, ' ', 'g'), {q(BREAKS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {q(TAGS)}, '', 'g')"
    for pattern, put in REFERENCES:
        text = f"regexp_replace({text}, {q(pattern)}, {q(put)}, 'g')"
    text = f"regexp_replace({text}, ' *\\n[ \\n]*', chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '^[ \\n]+', ''), '[ \\n]+$', '')"

    def urn(x):
        h = f"md5({x})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    crlf = "chr(13) || chr(10)"
    return f"""
WITH a AS (SELECT page_id, url, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
b AS (SELECT *, {urn("concat_ws('|', 'response', coalesce(CAST(page_id AS VARCHAR), ''), target_uri)")} AS refers_to,
             'sha1:' || sha1(payload) AS payload_digest, strlen(payload) AS size, {text} AS text,
             trim(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)', 1)) AS title,
             len(regexp_extract_all(payload, '(?i)<a\\s[^>]*href')) AS links FROM a),
c AS (
  SELECT page_id, url, refers_to, target_uri, payload_digest, 'metadata' AS kind, 'application/json' AS content_type,
         '{{"status":"200","content_type":"text/html; charset=utf-8","content_length":"' || size || '","headers":[{{"name":"Content-Type","value":"text/html; charset=utf-8"}},{{"name":"Content-Length","value":"' || size || '"}}],"payload_bytes":' || size
         || ',"title":' || CAST(to_json(title) AS VARCHAR) || ',"links":' || links || '}}' AS content FROM b
  UNION ALL
  SELECT page_id, url, refers_to, target_uri, payload_digest, 'conversion', 'text/plain; charset=utf-8', text FROM b),
d AS (SELECT *, {urn("concat_ws('|', kind, refers_to)")} AS record_id, 'sha1:' || sha1(content) AS block_digest,
             CAST(strlen(content) AS BIGINT) AS content_length FROM c)
SELECT page_id, url, refers_to, payload_digest, kind, content_type, content, record_id, block_digest, content_length,
       'WARC/1.1' || {crlf} || 'WARC-Type: ' || kind || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf}
       || 'WARC-Refers-To: ' || refers_to || {crlf} || 'WARC-Target-URI: ' || target_uri || {crlf}
       || 'WARC-Date: {DATE}' || {crlf} || 'WARC-Block-Digest: ' || block_digest || {crlf}
       || 'WARC-Source-Payload-Digest: ' || payload_digest || {crlf} || 'Content-Type: ' || content_type || {crlf}
       || 'Content-Length: ' || content_length AS header
FROM d
"""


WARC_SQL = _sql()
