"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Every response record gives a metadata record (application/warc-fields: the HTTP headers that arrived with it, its
digests, title and number of links) and a conversion record (text/plain).  Both refer to the response by its record id,
target and date, and carry the response's payload digest; each has a block digest of its own.  Record ids are derived
from the response's id and the kind, so a repeated task writes the same record.

All of it is column expressions over one row.  ``write_records`` writes gzip members into files of a shared folder, one
file per task; ``read_records`` parses such files.

Defined cases: a response with null body gives records with empty text; null urls give an empty target; repeated
responses give the same records again; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
# Named references that the plain text resolves besides numeric ones of printable ASCII; &amp; comes last.
ENTITIES = [("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
# (pattern, replacement) in order; both engines that run them know this syntax.
TEXT_STEPS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(?:script|style|noscript|template)\b.*?</(?:script|style|noscript|template)\s*>", ""),
    (r"(?is)<title\b.*?</title\s*>", ""),
    (r"(?i)</?(?:p|br|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|main|blockquote|pre|body|head|html)\b[^>]*>", "\n"),
    (r"<[/!a-zA-Z][^>]*>", ""),
]
SPACE_STEPS = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]


def _replace(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def plain_text(html: Column) -> Column:
    c = _replace(F.coalesce(html, F.lit("")), TEXT_STEPS)
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return _replace(c, SPACE_STEPS)


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def record_id(seed: Column) -> Column:
    """<urn:uuid:...> from the md5 of a seed."""
    h = F.md5(seed.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _block(lines: list[tuple[str, Column]]) -> Column:
    return F.concat(*[x for name, v in lines for x in (F.lit(f"{name}: "), v, F.lit("\r\n"))])


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of fetched pages: page_id, record_id, target_uri, date, http_headers, body, payload_digest."""
    body = F.coalesce(F.col("html"), F.lit(""))
    url = F.coalesce(F.col("url"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    seed = F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url)
    return pages.select("page_id", record_id(seed).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), body.alias("body"), digest(body).alias("payload_digest"))


def derive(found: DataFrame) -> DataFrame:
    """Two rows per response: page_id, type, record_id, refers_to, target_uri, source_digest, content_type, block, block_digest, content_length, record."""
    text = plain_text(F.col("body"))
    title = _replace(F.regexp_extract("body", r"(?is)<title\b[^>]*>(.*?)</title", 1), [(r"\s+", " ")])
    links = F.size(F.regexp_extract_all("body", F.lit(r"(?i)<a\s[^>]*?href\s*="), 0))
    about = F.concat(_block([("title", title), ("links", links.cast("string")), ("source-payload-digest", F.col("payload_digest")), ("source-length", F.octet_length("body").cast("string"))]),
                     F.regexp_replace("http_headers", r"(?m)^", "source-header: "))
    both = found.select("page_id", "record_id", "target_uri", "date", "payload_digest", F.inline(F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")))))
    named = both.select("page_id", "type", record_id(F.concat_ws("|", "type", "record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date",
                        F.col("payload_digest").alias("source_digest"), "content_type", "block", digest(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"))
    head = _block([("WARC-Type", F.col("type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.col("refers_to")),
                   ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("date")), ("WARC-Source-Payload-Digest", F.col("source_digest")),
                   ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string"))])
    return named.withColumn("record", F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")))


def write_records(records: DataFrame, folder: str) -> DataFrame:
    """Write the ``record`` column as gzip members, one .warc.gz per task; returns name and n_records per file (lazy)."""
    from paysieve.llm.tokens import _SharedFile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        name, file, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", None, 0
        for b in batches:
            file = file or (_SharedFile(folder, name) if len(b) else None)
            for r in b["record"]:
                file.write(gzip.compress(r.encode(), mtime=0))
                n += 1
        if file:
            file.commit()
            yield pd.DataFrame({"name": [name], "n_records": [n]})

    return records.select("record").mapInPandas(run, "name string, n_records long")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], str]]:
    """(headers, block) of every record of an unpacked WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4:end + 4 + size].decode()
        at = end + 4 + size + 4


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """headers (map) and block per record of the .warc.gz files of a folder; a file is read by one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(list(parse_records(gzip.decompress(content))), columns=["headers", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInPandas(run, "headers map<string,string>, block string")
