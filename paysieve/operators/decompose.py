"""Request -> parts.  Parts of one request are built inside its row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.functions import text as T
from paysieve.functions.text import let

PART = "array<struct<location:string,field:string,raw:string>>"
PAIRS = "array<struct<key:string,val:string>>"
# Headers that never become parts; path segments that look like payload.
SKIPPED_HEADERS = ["host", "user-agent", "accept", "connection", "content-type"]
SEGMENT_PATTERN = r"(?i)(union|select|script|alert|onerror|\.\./|etc/passwd|<|>|%27|%22)"


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _after(c: Column, sep: str) -> Column:
    at = F.instr(c, sep)
    return F.when(at > 0, F.substr(c, at + len(sep))).otherwise("")


def pairs_of(query: Column) -> Column:
    """All key/value pairs in order, decoded; repeated keys and blank values are kept."""
    chunks = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: x != "")
    return F.transform(chunks, lambda x: F.struct(
        T.url_plus(F.substring_index(x, "=", 1)).alias("key"), T.url_plus(_after(x, "=")).alias("val")))


def grouped_pairs(query: Column) -> Column:
    """Pairs regrouped per key in first-seen order."""
    def order(ps: Column) -> Column:
        keys = F.transform(ps, lambda p: p["key"])
        tagged = F.transform(ps, lambda p, i: F.struct(F.array_position(keys, p["key"]).alias("f"), i.alias("i"), p.alias("p")))
        return F.transform(F.array_sort(tagged), lambda t: t["p"])
    return let(pairs_of(query), order)


def cookie_pairs(header: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(header, F.lit("")), ";"), lambda x: x.contains("="))
    return F.transform(parts, lambda x: F.struct(
        F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(_after(x, "=")).alias("val")))


def is_json(body: Column) -> Column:
    return F.startswith(T.strip(body), F.lit("{"))


def json_top(body: Column) -> Column:
    """One level of a JSON object; values as text, nested values as JSON text."""
    m = F.try_parse_json(body).cast("map<string,variant>")
    return F.when(is_json(body), F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].alias("key"), leaf_text(e["value"]).alias("val"))))


def leaf_text(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(v.cast("string"))) \
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(v)).otherwise(v.cast("string"))


def json_leaves(body: Column, depth: int = 8) -> Column:
    """(dotted.path[i], text) of every leaf down to ``depth`` levels, as one bounded fold."""
    typ = "array<struct<path:string,v:variant>>"

    def expand(e: Column) -> Column:
        kind = F.schema_of_variant(e["v"])
        obj = F.transform(F.map_entries(e["v"].cast("map<string,variant>")), lambda m: F.struct(
            F.when(e["path"] == "", m["key"]).otherwise(F.concat(e["path"], F.lit("."), m["key"])).alias("path"), m["value"].alias("v")))
        arr = F.transform(e["v"].cast("array<variant>"), lambda x, i: F.struct(
            F.concat(e["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v")))
        return F.when(kind.startswith("OBJECT"), obj).when(kind.startswith("ARRAY"), arr).otherwise(F.array(e)).cast(typ)

    def level(acc: Column, _i: Column) -> Column:
        return F.flatten(F.transform(acc, expand)).cast(typ)
    start = F.array(F.struct(F.lit("").alias("path"), F.try_parse_json(body).alias("v"))).cast(typ)
    leaves = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, level)
    out = F.transform(leaves, lambda e: F.struct(
        F.when(e["path"] == "", "value").otherwise(e["path"]).alias("key"), leaf_text(e["v"]).alias("val")))
    return F.when(is_json(body) & F.try_parse_json(body).isNotNull(), out)


def is_multipart(body: Column, ctype: Column) -> Column:
    return F.lower(ctype).contains("multipart") | body.contains("WebKitFormBoundary")


def multipart_pairs(body: Column, ctype: Column) -> Column:
    declared = F.trim(F.regexp_extract(ctype, r"(?i)boundary=([^\s;]+)", 1), F.lit('"'))
    found = F.regexp_extract(body, r"(-{2,}WebKitFormBoundary[\w\-]+)", 1)
    core = F.ltrim(F.when(declared != "", declared).otherwise(found), F.lit("-"))
    chunks = F.transform(F.split(body, F.concat(F.lit("\\Q--"), core, F.lit("\\E"))), lambda c: F.trim(c, F.lit("\r\n-")))
    named = F.filter(chunks, lambda c: c.rlike('(?i)name="[^"]+"'))

    def value(c: Column) -> Column:
        return F.when(c.contains("\r\n\r\n"), T.strip(_after(c, "\r\n\r\n"))) \
            .when(c.contains("\n\n"), T.strip(_after(c, "\n\n"))).otherwise(c)
    out = F.transform(named, lambda c: F.struct(F.regexp_extract(c, '(?i)name="([^"]+)"', 1).alias("key"), value(c).alias("val")))
    return F.when(is_multipart(body, ctype) & (core != ""), out)


def as_parts(location: str, pairs: Column, blank_key: str | None = None) -> Column:
    key = (lambda p: p["key"]) if blank_key is None else (lambda p: F.when(p["key"] == "", blank_key).otherwise(p["key"]))
    return F.coalesce(F.transform(pairs, lambda p: F.struct(
        F.lit(location).alias("location"), key(p).alias("field"), p["val"].alias("raw"))), F.array()).cast(PART)


def path_parts(url: Column) -> Column:
    segs = F.transform(F.split(path_of(url), "/"), T.url_plus)
    hit = F.filter(segs, lambda s: (F.length(s) >= 3) & s.rlike(SEGMENT_PATTERN))
    return F.transform(hit, lambda s: F.struct(F.lit("path").alias("location"), F.lit("segment").alias("field"), s.alias("raw"))).cast(PART)


def header_parts(headers: Column) -> Column:
    kept = F.filter(F.map_entries(headers), lambda e: ~F.lower(e["key"]).isin(SKIPPED_HEADERS))
    return as_parts("header", F.transform(kept, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("val"))))


def body_raw(body: Column) -> Column:
    one = F.array(F.struct(F.lit("body").alias("location"), F.lit("raw").alias("field"), body.alias("raw"))).cast(PART)
    return F.when(body != "", one).otherwise(F.array().cast(PART))


def form_pairs(body: Column, ctype: Column) -> Column:
    return F.when((body != "") & ~is_json(body), pairs_of(body))


def normalized_parts(url: Column, body: Column, ctype: Column) -> Column:
    """Query pairs, raw body, then exactly one of JSON leaves, multipart fields, form pairs."""
    body_part = F.when(is_json(body), as_parts("json", json_leaves(body))) \
        .when(is_multipart(body, ctype), as_parts("multipart", multipart_pairs(body, ctype))) \
        .otherwise(as_parts("form", F.when(body != "", pairs_of(body)), "field"))
    return F.concat(as_parts("query", pairs_of(query_of(url)), "hpp"), body_raw(body), body_part)


def merged_parts(url: Column, headers: Column, cookie: Column, body: Column, ctype: Column) -> Column:
    """Basic parts followed by the normalised parts that are not among them."""
    head = F.concat(as_parts("query", grouped_pairs(query_of(url))), path_parts(url), header_parts(headers), as_parts("cookie", cookie_pairs(cookie)))
    multi = as_parts("multipart", multipart_pairs(body, ctype))
    basic = F.concat(head, body_raw(body), F.when(is_json(body), as_parts("json", json_top(body))).otherwise(as_parts("form", form_pairs(body, ctype))))
    extra = let(F.struct(basic.alias("b"), F.array_distinct(normalized_parts(url, body, ctype)).alias("n")),
                lambda s: F.concat(s["b"], F.filter(s["n"], lambda p: ~F.array_contains(s["b"], p))))
    return F.when(body == "", head).when(is_multipart(body, ctype), F.concat(head, multi)).otherwise(extra)


def explode_parts(df: DataFrame, parts: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(parts).alias("pos", "p")).select(*keep, "pos", "p.location", "p.field", "p.raw")


def request_parts(df: DataFrame, *keep: str) -> DataFrame:
    parts = merged_parts(F.col("url"), F.col("headers"), F.col("cookie"), F.col("body"), F.col("ctype"))
    return explode_parts(df, parts, "req_id", *keep)


def protocol_score(url: Column, body: Column, ctype: Column) -> Column:
    """Maximum of the protocol anomaly terms, 0..1."""
    keys = F.transform(pairs_of(query_of(url)), lambda p: p["key"])
    repeated = let(keys, lambda k: F.size(k) != F.size(F.array_distinct(k)))
    leaves = let(json_leaves(body), lambda ls: F.greatest(
        F.when(F.exists(ls, lambda p: p["key"].rlike(r"[.\[]")), 0.25).otherwise(0.0),
        F.when(F.size(ls) > 3, 0.15).otherwise(0.0)))
    as_json = F.when(is_json(body), F.when(F.try_parse_json(body).isNull(), 0.2).otherwise(leaves)).otherwise(0.0)
    return F.greatest(F.when(repeated, 0.35).otherwise(0.0), as_json, F.when((body != "") & is_multipart(body, ctype), 0.3).otherwise(0.0))


def source_key(headers: Column, session: Column | None = None) -> Column:
    ip = F.coalesce(headers["X-Forwarded-For"], headers["X-Real-IP"], F.lit("default"))
    return ip if session is None else F.concat_ws(":", ip, session)


def aggregate_text(url: Column, body: Column) -> tuple[Column, Column]:
    """(encoded, decoded) text of the whole request: body, the p= value, or the query."""
    qs = query_of(url)
    single = F.regexp_extract(qs, r"^p=([^&]*)$", 1)
    enc = F.when(body != "", body).when(qs.rlike("^p=[^&]*$"), single).otherwise(qs)
    return enc, T.url_plus(enc)
