"""Derived views over the test tables (requests, payload rows, pages as requests)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.session import spread_rows
from paysieve.templates import ROWS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], ddl: list[tuple[str, pa.DataType]]) -> DataFrame:
    """A small literal dimension; Arrow input becomes a LocalRelation with a known size."""
    cols = {name: pa.array([r[i] for r in rows], typ) for i, (name, typ) in enumerate(ddl)}
    return spark.createDataFrame(pa.table(cols))


def template_table(spark: SparkSession) -> DataFrame:
    return local_table(
        spark, ROWS,
        [("pid", pa.int64()), ("tpl", pa.string()), ("label", pa.string()), ("kind", pa.string())],
    )


def payload_rows(spark: SparkSession, sf: str) -> DataFrame:
    """events x templates: one labelled payload per event (64-row side is broadcast)."""
    ev = spread_rows(table(spark, sf, "events"))
    tpl = F.broadcast(template_table(spark))
    text = F.replace(
        F.replace(F.col("tpl"), F.lit("{n}"), F.col("event_id").cast("string")),
        F.lit("{u}"), F.col("user_id").cast("string"),
    )
    return ev.join(tpl, F.pmod(F.col("event_id"), F.lit(64)) == F.col("pid")).select(
        F.col("event_id").alias("row_id"), "ts", F.col("user_id").cast("string").alias("src"),
        text.alias("payload"), "label", "kind",
        F.concat_ws(":", F.col("event_type"), F.col("kind")).alias("source"), "props",
    )


def quote(c: Column) -> Column:
    """Percent-quote with the unreserved set ``A-Za-z0-9-._~``."""
    enc = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return enc


def transport(payload: Column) -> tuple[Column, Column, Column]:
    """(method, url, body): POST where a query string would be cut, quoted GET otherwise."""
    post = payload.rlike("[&\r\n]") | (F.length(payload) > 1800) | payload.startswith("{")
    base = "http://eval.local/test"
    return (
        F.when(post, "POST").otherwise("GET"),
        F.when(post, base).otherwise(F.concat(F.lit(base + "?p="), quote(payload))),
        F.when(post, payload).otherwise(""),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    p = payload_rows(spark, sf)
    method, url, body = transport(F.col("payload"))
    k = F.get_json_object("props", "$.k")
    ctype = F.when(F.col("payload").startswith("------WebKit"), "multipart/form-data; boundary=----WebKitFormBoundaryQ7x") \
        .when(F.col("payload").startswith("{"), "application/json").otherwise("")
    headers = F.create_map(
        F.lit("Accept"), F.lit("*/*"),
        F.lit("X-Forwarded-For"), F.col("src"),
        F.lit("Cookie"), F.col("cookie"),
        F.lit("Content-Type"), ctype,
        F.lit("Referer"), F.concat(F.lit("http://site.test/"), F.split_part("source", F.lit(":"), F.lit(1))),
    )
    cookie = F.concat(F.lit("sid="), F.coalesce(k, F.lit("none")), F.lit("; theme ="), F.col("kind"), F.lit("; flag"))
    return p.withColumn("cookie", cookie).select(
        F.col("row_id").alias("req_id"), "ts", "src", method.alias("method"), url.alias("url"),
        headers.alias("headers"), body.alias("body"), ctype.alias("ctype"), "cookie", "payload", "label", "kind", "source", "props",
    )
