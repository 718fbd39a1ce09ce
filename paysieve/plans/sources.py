"""Ingest job: sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paysieve.fixtures import payload_rows, requests, table
from paysieve.functions import text as T
from paysieve.functions.labels import first_match, infer_label
from paysieve.operators import decompose as D
from paysieve.plans.evaluate import feedback, misses, predictions
from paysieve.plans.registry import query
from paysieve.session import spread
from paysieve.sources import files as S
from paysieve.sources import logs as G


@query("src_labeled_csv")
def _csv(spark, sf):
    path = S.write_labeled_csv(payload_rows(spark, sf), S.scratch(spark, "labeled"))
    return S.read_labeled_csv(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("chars"))


@query("snk_csv")
def _scsv(spark, sf):
    path = S.write_labeled_csv(payload_rows(spark, sf), S.scratch(spark, "full"))
    return S.read_labeled_csv(spark, path).groupBy("source").agg(F.count("*").alias("n"))


@query("src_request_csv")
def _rcsv(spark, sf):
    path = S.scratch(spark, "requests")
    r = requests(spark, sf).select(F.when(F.pmod("req_id", F.lit(10)) == 0, F.lit(None)).otherwise(F.col("method")).alias("method"), "url", "body")
    r.write.options(**S.CSV).csv(path)
    return S.read_request_csv(spark, path).groupBy("method", "source").agg(F.count("*").alias("n"), F.count_if(F.col("body") != "").alias("with_body"), F.sum(F.length("url")).alias("url_chars"))


def raw_http():
    """Requests rendered as HTTP/1.x text."""
    head = F.concat(F.col("method"), F.lit(" "), F.col("url"), F.lit(" HTTP/1.1\nHost: eval.local\nX-Forwarded-For: "), F.col("src"), F.lit("\nCookie: "), F.col("cookie"), F.lit("\n\n"))
    return F.concat(head, F.col("body"))


@query("src_http1_log")
def _h1(spark, sf):
    df = requests(spark, sf).select("req_id", raw_http().alias("raw"))
    p = G.parse_http1(F.col("raw"))
    return df.select("req_id", p.alias("p")).select("req_id", "p.method", "p.url", F.size("p.headers").cast("bigint").alias("n_headers"), F.col("p.headers")["X-Forwarded-For"].alias("xff"), "p.body")


@query("src_http2_json_log")
def _h2(spark, sf):
    js = F.to_json(F.struct(F.col("method").alias(":method"), F.col("url").alias(":path"), F.struct(F.col("src").alias("x-forwarded-for")).alias("headers"), F.col("body").alias("body")))
    plain = F.to_json(F.struct(F.col("method").alias("method"), F.col("url").alias("url"), F.col("body").alias("body")))
    raw = F.when(F.pmod("req_id", F.lit(3)) == 0, js).when(F.pmod("req_id", F.lit(3)) == 1, plain).otherwise(raw_http())
    df = requests(spark, sf).select("req_id", raw.alias("raw"))
    return df.select("req_id", G.parse_http2(F.col("raw")).alias("p")).select("req_id", "p.method", "p.url", "p.body", "p.protocol")


@query("src_protocol_tag")
def _tag(spark, sf):
    hint = first_match([(F.pmod("req_id", F.lit(3)) == 0, F.lit("HTTP/3")), (F.pmod("req_id", F.lit(3)) == 1, F.lit("WS"))], "HTTP/1.1")
    df = requests(spark, sf).select("req_id", hint.alias("hint"), raw_http().alias("raw"))
    return df.select("req_id", G.parse_by_protocol(F.col("raw"), F.col("hint")).alias("p")).select("req_id", "p.method", "p.url", "p.protocol", "p.source", F.length("p.body").cast("bigint").alias("body_chars"))


@query("src_csic_csv")
def _csic(spark, sf):
    df = requests(spark, sf).select("req_id", F.col("payload"), "url", F.concat(F.lit("sid="), F.col("src")).alias("cookie"), F.when(F.col("label") == "Normal", "norm").otherwise("anom").alias("raw_label"))
    frag = G.longest_fragment(F.col("payload"), F.col("url"), F.col("cookie"))
    df = df.select("req_id", "raw_label", frag.alias("fragment")).filter(F.length("fragment") >= 2)
    return df.select("req_id", "fragment", infer_label(F.col("fragment"), F.col("raw_label")).alias("label"))


def gsi_blocks(spark, sf):
    cls = F.when(F.col("label") == "Normal", "Valid").otherwise("Attack")
    return requests(spark, sf).select("req_id", F.concat(F.lit("Start - Id: "), F.col("req_id"), F.lit("\nclass: "), cls, F.lit("\n"), raw_http(), F.lit("\nEnd - Id: "), F.col("req_id")).alias("text"))


@query("src_gsi_blocks")
def _gsi(spark, sf):
    b = G.labelled_blocks(gsi_blocks(spark, sf), "text", "req_id")
    rows = b.select("req_id", "raw_label", F.explode(G.block_payloads(F.col("block"))).alias("payload"))
    return rows.select("req_id", "payload", infer_label(F.col("payload"), F.col("raw_label")).alias("label"))


@query("src_block_payloads")
def _bp(spark, sf):
    df = requests(spark, sf).select("req_id", raw_http().alias("block"))
    return df.select("req_id", F.posexplode(G.block_payloads(F.col("block"))).alias("pos", "payload")).withColumn("pos", F.col("pos").cast("bigint"))


@query("src_blankline_blocks")
def _bl(spark, sf):
    path = S.scratch(spark, "anomalous")
    S.write_blank_line_blocks(requests(spark, sf), path)
    b = S.read_blank_line_blocks(spark, path)
    rows = b.select("raw_label", F.explode(G.block_payloads(F.col("block"))).alias("payload"))
    return rows.groupBy(infer_label(F.col("payload"), F.col("raw_label")).alias("label")).agg(F.count("*").alias("n"))


def doc_lines(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line")))


@query("src_payload_lines")
def _lines(spark, sf):
    d = doc_lines(spark, sf).filter((F.col("line") != "") & ~F.col("line").rlike(r"^\s*#|^//|^(?i:note:)") & F.length("line").between(3, 4096))
    return d.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line", G.label_or_default(F.col("line"), F.lit("XSS")).alias("label"))


@query("src_seed_payloads")
def _seed(spark, sf):
    p = payload_rows(spark, sf).select("row_id", T.strip(F.col("payload")).alias("line")).filter(F.length("line").between(3, 4096))
    first = infer_label(F.col("line"))
    return p.select("row_id", F.when(first == "Normal", infer_label(F.col("line"), F.lit("SQLi"))).otherwise(first).alias("label"))


def marked_texts(spark, sf):
    """Documents with a fence, inline code and HTML code spans around parts of their text."""
    t = F.concat(F.lit("```sql\n"), F.substring("text", 1, 120), F.lit("\n```\n"), F.regexp_replace("text", "([A-Z][a-z]{4,})", "`$1`"), F.lit("\n<code>"), F.substring_index("text", ".", 1), F.lit("</code>"))
    return spread(table(spark, sf, "documents")).select("doc_id", t.alias("text"))


@query("src_codeblock_mining")
def _mine(spark, sf):
    d = marked_texts(spark, sf)
    return d.select("doc_id", F.explode(G.mined_payloads(F.col("text"))).alias("payload")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("chars"), F.min("payload").alias("lo"), F.max("payload").alias("hi"))


@query("src_link_extract")
def _links(spark, sf):
    """Titled links of saved pages, absolute, one row per link, first five per host."""
    p = spread(table(spark, sf, "pages")).select("page_id", "url", F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("base"), "html")
    links = p.select("page_id", "base", F.posexplode(G.link_pairs(F.col("html"))).alias("pos", "l")).select("page_id", "base", "pos", G.absolute(F.col("l.href"), F.col("base")).alias("link"), F.trim("l.title").alias("title"))
    links = links.filter((F.length("title") >= 6) & (F.lower("title").rlike(r"an|th|en|ci") | F.lower("link").contains("waf")))
    first = links.groupBy("link").agg(F.min(F.struct("page_id", "pos", "base", "title")).alias("f")).select("link", "f.*")
    w = Window.partitionBy("base").orderBy("page_id", "pos")
    return first.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("base", "link", "title", "page_id")


@query("src_article_payloads")
def _art(spark, sf):
    p = spread(table(spark, sf, "pages")).select("page_id", F.explode(G.mined_payloads(F.regexp_replace("html", "><", ">\n<"))).alias("payload"))
    lab = p.select("page_id", infer_label(F.col("payload")).alias("label"), F.length("payload").alias("n"))
    return lab.filter("label <> 'Normal'").groupBy("page_id", "label").agg(F.count("*").alias("n"), F.sum("n").alias("chars"))


@query("src_jsonl")
def _jsonl(spark, sf):
    path = S.scratch(spark, "misses")
    misses(spark, sf).select(F.col("row_id").alias("seq"), "payload", F.when(F.pmod("row_id", F.lit(2)) == 0, F.col("label")).alias("label"), F.when(F.pmod("row_id", F.lit(2)) == 1, F.col("label")).alias("true_label"), "source", "pred").write.json(path)
    return S.read_jsonl(spark, path).orderBy(F.desc("seq")).limit(200).select("seq", "payload", "label", "pred", "source")


@query("snk_miss_fp_jsonl")
def _mf(spark, sf):
    """Missed obfuscated attacks and flagged normals as two JSON tables, written from one scored frame."""
    p = predictions(spark, sf)
    a, b = S.scratch(spark, "obf-miss"), S.scratch(spark, "normal-fp")
    p.filter("label<>'Normal' AND kind<>'plain' AND pred='Normal'").select("row_id", "payload", "label", "source", "pred").write.json(a)
    p.filter("label='Normal' AND (pred<>'Normal' OR conf<0.9)").select("row_id", "payload", "label", "pred", "conf", "source").write.json(b)
    ddl = "row_id BIGINT, payload STRING, label STRING, source STRING, pred STRING, conf DOUBLE"
    both = spark.read.schema(ddl).json(a).withColumn("sink", F.lit("miss")).unionByName(spark.read.schema(ddl).json(b).withColumn("sink", F.lit("fp")))
    return both.groupBy("sink", "label").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("snk_failure_log")
def _fail(spark, sf):
    path = S.scratch(spark, "failures")
    f = feedback(spark, sf).filter("predicted<>true_label").select(F.concat(F.lit("/r/"), F.col("seq")).alias("url"), "true_label", "predicted", "payload")
    f.filter("true_label='SQLi'").write.mode("append").json(path)
    f.filter("true_label<>'SQLi'").write.mode("append").json(path)
    return spark.read.schema("url STRING, true_label STRING, predicted STRING, payload STRING").json(path).groupBy("true_label", "predicted").agg(F.count("*").alias("n"))


@query("snk_metrics_json")
def _mj(spark, sf):
    path = S.scratch(spark, "metrics")
    m = predictions(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") != "Normal").cast("double")), 4).alias("flag_rate"))
    m.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return spark.read.schema("label STRING, n BIGINT, flag_rate DOUBLE").json(path)


# Default rule patterns per class.
DEFAULT_PATTERN = {"SQLi": r"union\s+select", "XSS": "<script", "CMD": "[;&|]", "PathTraversal": r"\.\./", "FileInclusion": "php://"}


def rule_text(span, label):
    escaped = F.regexp_replace(F.regexp_replace(F.trim(span), r"([^A-Za-z0-9_ ])", r"\\$1"), " ", r"\\s+")
    pattern = F.when(span != "", escaped).otherwise(first_match([(label == k, F.lit(v)) for k, v in DEFAULT_PATTERN.items()], ""))
    return F.format_string("SecRule ARGS \"@rx %s\" \"id:10001,phase:2,deny,msg:'%s detected'\"", pattern, label), \
        F.format_string('alert http any any -> any any (msg:"%s"; content:"%s"; sid:90001;)', label, span)


@query("snk_waf_rules")
def _waf(spark, sf):
    p = predictions(spark, sf).filter("pred<>'Normal'").withColumn("span", F.regexp_extract("norm", r"(?i)(union\s+select|<script|\.\./|php://|<!entity|jndi:|ignore\s+previous)", 1))
    a, b = rule_text(F.col("span"), F.col("pred"))
    return p.groupBy(a.alias("modsecurity"), b.alias("suricata")).agg(F.count("*").alias("n"))


@query("job_ingest_summary")
def _ing(spark, sf):
    """Rows per input form; blocks without a request line or class are quarantined."""
    b = G.labelled_blocks(gsi_blocks(spark, sf).withColumn("text", F.when(F.pmod("req_id", F.lit(20)) == 0, F.regexp_replace("text", "class: [A-Za-z]+\n", "")).otherwise(F.col("text"))), "text", "req_id")
    return b.groupBy(F.when(F.col("class") == "", "bad_rows").otherwise("requests").alias("target"), "raw_label").agg(F.count("*").alias("n"))
