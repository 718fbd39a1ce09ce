"""Decompose job: requests -> parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.fixtures import payload_rows, requests, table, transport
from paysieve.functions import text as T
from paysieve.operators import decompose as D
from paysieve.plans.registry import query



def page_requests(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("req_id"), "url")


@query("req_build")
def _build(spark, sf):
    cookies = F.map_from_entries(D.cookie_pairs(F.col("cookie")))
    return requests(spark, sf).select(
        "req_id", F.upper(F.lower("method")).alias("method"), "url", F.coalesce(F.col("body"), F.lit("")).alias("body"),
        F.size(F.col("headers")).cast("bigint").alias("n_headers"), cookies["sid"].alias("sid"), F.lit("api").alias("origin"))


@query("req_cookies")
def _cookies(spark, sf):
    m = F.map_from_entries(D.cookie_pairs(F.col("cookie")))
    return requests(spark, sf).select("req_id", F.explode(m).alias("key", "val"))


@query("req_query_parts")
def _qparts(spark, sf):
    pages = page_requests(spark, sf).withColumn("origin", F.lit("page")).withColumn(
        "url", F.when(F.pmod("req_id", F.lit(3)) == 0, F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("b=1&a=2&b=%20x+y&c"))).otherwise(F.col("url")))
    reqs = requests(spark, sf).select("req_id", "url", F.lit("request").alias("origin"))
    both = pages.unionByName(reqs)
    return D.explode_parts(both, D.as_parts("query", D.grouped_pairs(D.query_of(F.col("url")))), "req_id", "origin") \
        .select("req_id", "origin", F.col("pos").cast("bigint").alias("pos"), "field", "raw")


@query("req_path_parts")
def _pparts(spark, sf):
    df = page_requests(spark, sf).withColumn("url", F.when(F.pmod("req_id", F.lit(2)) == 0, F.regexp_replace("url", r"(\.[a-z]+)/", "$1/%3Cscript%3E/")).otherwise(F.col("url")))
    return D.explode_parts(df, D.path_parts(F.col("url")), "req_id").select("req_id", "location", "field", "raw")


@query("req_header_parts")
def _hparts(spark, sf):
    return D.explode_parts(requests(spark, sf), D.header_parts(F.col("headers")), "req_id").select("req_id", "field", "raw")


@query("req_cookie_parts")
def _cparts(spark, sf):
    return D.explode_parts(requests(spark, sf), D.as_parts("cookie", D.cookie_pairs(F.col("cookie"))), "req_id").select("req_id", "location", "field", "raw")


@query("req_body_raw_form")
def _bparts(spark, sf):
    form = F.when(~D.is_multipart(F.col("body"), F.col("ctype")), D.form_pairs(F.col("body"), F.col("ctype")))
    parts = F.concat(D.body_raw(F.col("body")), D.as_parts("form", form))
    return D.explode_parts(requests(spark, sf), parts, "req_id").select("req_id", F.col("pos").cast("bigint").alias("pos"), "location", "field", "raw")


def json_bodies(spark, sf):
    """events.props widened to a nested document, plus the JSON request bodies."""
    doc = F.concat(F.lit('{"a": {"b": [1, {"c": "x'), F.col("event_id").cast("string"), F.lit('"}, true]}, "n": null, "p": '), F.col("props"), F.lit("}"))
    ev = table(spark, sf, "events").select(F.col("event_id").alias("req_id"), F.lit("event").alias("origin"), doc.alias("body"))
    rq = requests(spark, sf).filter(D.is_json(F.col("body"))).select("req_id", F.lit("request").alias("origin"), "body")
    return ev.unionByName(rq)


@query("req_json_top")
def _jtop(spark, sf):
    return D.explode_parts(json_bodies(spark, sf), D.as_parts("json", D.json_top(F.col("body"))), "req_id", "origin").select("req_id", "origin", "field", "raw")


@query("req_json_flatten")
def _jflat(spark, sf):
    return D.explode_parts(json_bodies(spark, sf), D.as_parts("json", D.json_leaves(F.col("body"))), "req_id", "origin").select("req_id", "origin", "field", "raw")


@query("req_multipart")
def _multi(spark, sf):
    return D.explode_parts(requests(spark, sf), D.as_parts("multipart", D.multipart_pairs(F.col("body"), F.col("ctype"))), "req_id").select("req_id", "field", "raw")


@query("req_hpp_pairs")
def _hpp(spark, sf):
    df = page_requests(spark, sf).withColumn("q", F.concat_ws("&", D.query_of(F.col("url")), F.lit("id=1&&id=2&flag"), F.concat(F.lit("id="), F.col("req_id"))))
    return D.explode_parts(df, D.as_parts("query", D.pairs_of(F.col("q")), "hpp"), "req_id").select("req_id", F.col("pos").cast("bigint").alias("pos"), "field", "raw")


@query("req_normalized_parts")
def _nparts(spark, sf):
    return D.explode_parts(requests(spark, sf), D.normalized_parts(F.col("url"), F.col("body"), F.col("ctype")), "req_id").select("req_id", "location", "field", "raw")


@query("req_merge_parts")
def _mparts(spark, sf):
    return D.request_parts(requests(spark, sf)).select("req_id", "location", "field", "raw")


@query("job_decompose_summary")
def _msum(spark, sf):
    return D.request_parts(requests(spark, sf)).groupBy("location").agg(F.count("*").alias("n_parts"), F.sum(F.length("raw")).alias("chars"))


@query("req_protocol_score")
def _score(spark, sf):
    return requests(spark, sf).select("req_id", D.protocol_score(F.col("url"), F.col("body"), F.col("ctype")).alias("score"))


@query("req_eval_transport")
def _transport(spark, sf):
    m, u, b = transport(F.col("payload"))
    return payload_rows(spark, sf).select("row_id", m.alias("method"), u.alias("url"), b.alias("body"))


@query("req_source_key")
def _skey(spark, sf):
    return requests(spark, sf).select("req_id", D.source_key(F.col("headers")).alias("src_key"), D.source_key(F.col("headers"), F.map_from_entries(D.cookie_pairs(F.col("cookie")))["sid"]).alias("session_key"))


@query("req_aggregate_text")
def _agg(spark, sf):
    enc, dec = D.aggregate_text(F.col("url"), F.col("body"))
    return requests(spark, sf).select("req_id", enc.alias("encoded"), F.replace(dec, F.lit("\u0000"), F.lit("<NUL>")).alias("decoded"))
