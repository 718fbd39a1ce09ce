"""Text forms of requests and payloads -> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.functions import text as T
from paysieve.functions.labels import infer_label
from paysieve.functions.text import let
from paysieve.operators.decompose import _after

REQUEST_LINE = r"(?im)^(GET|POST|PUT|DELETE|HEAD|OPTIONS)\s+(\S+)\s+HTTP/"


def _request(method: Column, url: Column, headers: Column, body: Column, protocol: Column | str, source: Column | str) -> Column:
    def lit(x):
        return F.lit(x) if isinstance(x, str) else x
    return F.struct(method.alias("method"), url.alias("url"), headers.alias("headers"), body.alias("body"), lit(protocol).alias("protocol"), lit(source).alias("source"))


def parse_http1(raw: Column, protocol: str = "HTTP/1.1", source: str = "api") -> Column:
    """First line, ``name: value`` lines up to the first blank line, then the body."""
    def build(s: Column) -> Column:
        blank = F.regexp_instr(s, F.lit(r"\n[ \t\r]*(?:\n|$)"))
        head = F.when(blank > 0, F.substr(s, F.lit(1), blank - 1)).otherwise(s)
        body = F.when(blank > 0, T.strip(F.substr(s, blank + 1))).otherwise("")
        lines = F.split(head, "\n")
        words = F.split(T.strip(lines[0]), r"\s+")
        fields = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.contains(":"))
        headers = F.map_from_entries(F.transform(fields, lambda x: F.struct(T.strip(F.substring_index(x, ":", 1)).alias("k"), T.strip(_after(x, ":")).alias("v"))))
        method = F.when(words[0] == "", "GET").otherwise(F.upper(words[0]))
        return _request(method, F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")), headers, body, protocol, source)
    return let(T.strip(raw), build)


def parse_http2(raw: Column) -> Column:
    """JSON export with pseudo headers, plain names as fallback, HTTP/1 text when it is not JSON."""
    v = F.try_parse_json(raw)

    def pick(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    headers = F.coalesce(F.try_variant_get(v, "$.headers", "map<string,string>"), F.create_map().cast("map<string,string>"))
    as_json = _request(F.coalesce(pick('$[":method"]', "$.method"), F.lit("GET")), F.coalesce(pick('$[":path"]', "$.url"), F.lit("")), headers, F.coalesce(pick("$.body"), F.lit("")), "HTTP/2", "http2")
    return F.when(v.isNull(), parse_http1(raw, "HTTP/2", "api")).otherwise(as_json)


def parse_by_protocol(raw: Column, hint: Column) -> Column:
    up = F.upper(hint)
    frame = _request(F.lit("WS"), F.lit("/websocket"), F.create_map().cast("map<string,string>"), raw, "WebSocket", "websocket")
    return F.when(up.isin("HTTP/2", "H2"), parse_http2(raw)).when(up.isin("HTTP/3", "QUIC"), parse_http1(raw, "HTTP/3", "quic")) \
        .when(up.isin("WEBSOCKET", "WS"), frame).otherwise(parse_http1(raw))


def longest_fragment(payload: Column, url: Column, cookie: Column) -> Column:
    """Longest candidate of payload, query, url and cookie values; the first one wins a tie."""
    def clean(c: Column) -> Column:
        s = T.strip(F.coalesce(c, F.lit("")))
        return F.when(F.lower(s) == "null", "").otherwise(s)

    def values(c: Column) -> Column:
        parts = F.transform(F.split(c, "&"), lambda x: F.when(x.contains("="), _after(x, "=")).otherwise(x))
        return F.when(c == "", F.array().cast("array<string>")).when(c.contains("="), parts).otherwise(F.array(c))
    u = clean(url)
    from_url = F.when(u == "", F.array().cast("array<string>")).when(u.contains("?"), F.array(_after(u, "?"), u)).otherwise(F.array(u))
    cand = F.concat(values(clean(payload)), from_url, values(clean(cookie)))
    best = F.array_max(F.transform(cand, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return F.coalesce(best["x"], F.lit(""))


def labelled_blocks(df: DataFrame, text: str, key: str) -> DataFrame:
    """Start/End blocks of a text column -> one row per block with its class."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)Start\s*-\s*Id:\s*\d+\s*\n(.*?)\nEnd\s*-\s*Id:\s*\d+"), F.lit(1))
    b = df.select(key, F.explode(found).alias("block"))
    cls = F.lower(F.regexp_extract("block", r"(?im)^class:\s*(Attack|Valid)\s*$", 1))
    return b.withColumns({"class": cls, "raw_label": F.when(cls == "attack", "anom").otherwise("norm")})


def unquote(c: Column) -> Column:
    return T.url_percent(c)


def block_payloads(block: Column) -> Column:
    """Query, cookie values and form values / body of one HTTP text block; the target when none is found."""
    empty = F.array().cast("array<string>")
    target = F.regexp_extract(block, REQUEST_LINE, 2)
    query = unquote(_after(target, "?"))
    has_q = target.contains("?")
    from_query = F.when(has_q & F.lower(target).rlike("https?://"), F.array(query, query)).when(has_q, F.array(query)).otherwise(empty)
    cookie_lines = F.filter(F.split(block, "\r?\n"), lambda x: F.startswith(F.lower(x), F.lit("cookie:")))
    segs = F.filter(F.transform(F.flatten(F.transform(cookie_lines, lambda x: F.split(_after(x, ":"), ";"))), lambda s: F.trim(s)), lambda s: s.contains("="))
    cookies = F.transform(segs, lambda s: _after(s, "="))
    body = T.strip(_after(block, "\n\n"))
    form = F.transform(F.split(body, "&"), lambda x: F.when(x.contains("="), unquote(_after(x, "="))).otherwise(x))
    use = (body != "") & (F.lower(body) != "null") & ~F.startswith(body, F.lit("HTTP/"))
    bodies = F.when(use & body.contains("="), form).when(use, F.array(body)).otherwise(empty)
    allp = F.concat(from_query, cookies, bodies)
    allp = F.when((F.size(allp) == 0) & (target != ""), F.array(target)).otherwise(allp)
    return F.filter(F.transform(allp, T.strip), lambda p: F.length(p) >= 2)


def label_or_default(line: Column, default: Column) -> Column:
    """Label of a line from a source with a default class; an SQLi source is labelled by text first."""
    lab = infer_label(line, F.when(default == "SQLi", "").otherwise(default))
    return F.when((lab == "Normal") & (default != "Normal"), default).otherwise(lab)


def mined_payloads(text: Column) -> Column:
    """Payload strings of fences, back-ticks, <code> spans and plain lines; first occurrence kept."""
    fences = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1)), lambda b: F.split(b, "\n")))
    ticks = F.regexp_extract_all(text, F.lit("`([^`\n]{4,512})`"), F.lit(1))
    code = F.regexp_extract_all(text, F.lit("(?i)<code[^>]*>([^<]{4,512})</code>"), F.lit(1))
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: ~F.lower(x).rlike(r"^//|^note:"))
    raw = F.concat(fences, ticks, code, lines)
    clean = F.transform(raw, lambda s: F.trim(T.strip(s), F.lit("'\"")))
    return F.array_distinct(F.filter(clean, lambda s: F.length(s).between(3, 4096) & ~F.lower(s).rlike(r"^\s*#|^(?:note:|example:|//|http://|https://)")))


def link_pairs(html: Column) -> Column:
    p = F.lit(r"(?i)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([^<]{4,200})</a>")
    return F.zip_with(F.regexp_extract_all(html, p, F.lit(1)), F.regexp_extract_all(html, p, F.lit(2)), lambda a, b: F.struct(F.trim(a).alias("href"), b.alias("title")))


def absolute(href: Column, base: Column) -> Column:
    return F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(base, href)).otherwise(F.concat(base, F.lit("/"), href))
