"""Explain and request-level decision queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paysieve.fixtures import requests
from paysieve.functions import features as X
from paysieve.functions import rules as R
from paysieve.functions.labels import first_match
from paysieve.functions.scoring import batch_scores
from paysieve.operators import decompose as D
from paysieve.operators import explain as E
from paysieve.plans.decide import request_verdicts
from paysieve.plans.evaluate import predictions
from paysieve.plans.featurise import ATTACK_SHAPES
from paysieve.plans.label import risk
from paysieve.plans.registry import query
from paysieve.session import evaluated_once



def flagged(spark, sf):
    return predictions(spark, sf).filter("pred <> 'Normal'")


def located(spark, sf):
    f = flagged(spark, sf)
    f = evaluated_once(f, "row_id", "label", "pred", "kind", "norm", "depth", "conf", loc=E.locate(F.col("norm"), F.col("pred")))
    f = f.withColumn("fine", F.when(F.col("loc.prio").between(0.1, 5.999), E.refine(F.col("norm"), F.col("pred"), F.col("loc.s"), F.col("loc.e"))).otherwise(F.struct(F.col("loc.s").alias("s"), F.col("loc.e").alias("e"))))
    return f.withColumns({"s": F.col("fine.s"), "e": F.col("fine.e")}).withColumn("span", F.substr(F.col("norm"), F.col("s") + 1, F.col("e") - F.col("s")))


def clean(c):
    return F.replace(c, F.lit("\u0000"), F.lit("<NUL>"))


@query("exp_locate_legacy")
def _leg(spark, sf):
    f = flagged(spark, sf).select("row_id", E.legacy(F.col("norm"), F.col("pred")).alias("g"))
    return f.select("row_id", clean(F.col("g.span")).alias("span"), F.col("g.s").cast("bigint").alias("s"), F.col("g.e").cast("bigint").alias("e"))


@query("exp_locate_span")
def _loc(spark, sf):
    f = flagged(spark, sf).select("row_id", E.locate(F.col("norm"), F.col("pred")).alias("g"))
    return f.select("row_id", F.col("g.prio").alias("prio"), F.col("g.s").cast("bigint").alias("s"), F.col("g.e").cast("bigint").alias("e"))


@query("exp_refine")
def _ref(spark, sf):
    return located(spark, sf).select("row_id", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), clean(F.col("span")).alias("span"))


@query("exp_highlight")
def _high(spark, sf):
    return located(spark, sf).select("row_id", clean(E.highlight(F.col("norm"), F.col("s"), F.col("e"))).alias("html"))


# Class names used in sentences.
NAMES = {"SQLi": "SQL injection", "XSS": "cross-site scripting", "CMD": "command injection", "PathTraversal": "path traversal", "FileInclusion": "file inclusion", "XXE": "XML external entity", "PromptInjection": "prompt injection"}


@query("exp_sentence")
def _sent(spark, sf):
    f = located(spark, sf)
    name = first_match([(F.col("pred") == k, F.lit(v)) for k, v in NAMES.items()], F.col("pred"))
    how = F.when(F.col("depth") > 0, F.concat(F.lit("after "), F.col("depth").cast("string"), F.lit(" decoding steps"))).otherwise("without encoding")
    text = F.concat(F.lit("The query field holds a "), name, F.lit(" pattern ("), clean(F.col("span")), F.lit(") "), how, F.lit(": "), risk(F.col("pred"), F.col("conf")), F.lit(" risk, confidence "), F.floor(F.round(F.col("conf") * 10000) / 100).cast("string"), F.lit("%."))
    return f.select("row_id", text.alias("sentence"))


@query("agg_iou")
def _iou(spark, sf):
    """Span hit rate and mean IoU of both localisers against the first class anchor."""
    f = located(spark, sf).withColumn("old", E.legacy(F.col("norm"), F.col("pred")))
    want = None
    for k, words in E.ANCHORS.items():
        pos = F.locate(words[0], F.lower(F.col("norm")))
        c = F.when(pos > 0, F.struct((pos - 1).alias("s"), (pos - 1 + len(words[0])).alias("e")))
        want = F.when(F.col("pred") == k, c) if want is None else want.when(F.col("pred") == k, c)
    f = f.withColumn("want", want).filter("want is not null")

    def iou(s, e):
        inter = F.greatest(F.lit(0), F.least(e, F.col("want.e")) - F.greatest(s, F.col("want.s")))
        return inter / F.greatest((e - s) + (F.col("want.e") - F.col("want.s")) - inter, F.lit(1))
    f = f.withColumns({"i_new": iou(F.col("s"), F.col("e")), "i_old": iou(F.col("old.s"), F.col("old.e"))})
    return f.groupBy("pred").agg(F.count("*").alias("n"), F.round(F.avg((F.col("i_new") > 0).cast("double")), 4).alias("hit"), F.round(F.avg("i_new"), 4).alias("iou"), F.round(F.avg("i_old"), 4).alias("iou_old"))


@query("job_explain_summary")
def _es(spark, sf):
    return located(spark, sf).groupBy("pred", "kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("e") - F.col("s")), 3).alias("mean_len"))


@query("sco_field_contrib")
def _contrib(spark, sf):
    """Share of each field of a request by anchors and markers (the parts of one request are bounded)."""
    parts = D.request_parts(requests(spark, sf), "label")
    hits = F.lit(0)
    for k, words in E.ANCHORS.items():
        n = F.lit(0)
        for w in words:
            n = n + F.lower("raw").contains(w).cast("int")
        hits = hits + F.when(F.col("label") == k, n).otherwise(0)
    w = F.round(0.1 + 0.25 * hits + 0.15 * F.least(F.lit(4), X.marker_score(F.col("raw"))), 3)
    rows = parts.groupBy("req_id", "location", "field").agg(F.max(w).alias("w"))
    return rows.select("req_id", "location", "field", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("req_id")), 3).alias("share"))


def aggregate_rows(spark, sf):
    """One row per request: encoded and decoded aggregate text, protocol score."""
    enc, dec = D.aggregate_text(F.col("url"), F.col("body"))
    return requests(spark, sf).select("req_id", enc.alias("enc"), dec.alias("dec"), D.protocol_score(F.col("url"), F.col("body"), F.col("ctype")).alias("pscore"))


@query("fus_request_rescue")
def _resc(spark, sf):
    """Rescue over the encoded, then the decoded aggregate text."""
    a = aggregate_rows(spark, sf).select("req_id", F.posexplode(F.array("enc", "dec")).alias("o", "raw"), F.col("dec").alias("norm"), F.lit(1).alias("depth"))
    s = batch_scores(a, ["req_id", "o"], ["rescue_label", "rescue_conf", "xxe_label", "xxe_conf"])
    lab = F.coalesce("xxe_label", "rescue_label")
    s = s.select("req_id", F.when(lab.isNotNull(), F.struct("o", lab.alias("label"), F.coalesce("xxe_conf", "rescue_conf").cast("double").alias("conf"))).alias("h"))
    return s.groupBy("req_id").agg(F.min("h").alias("h")).select("req_id", F.col("h.label").alias("verdict"), F.round("h.conf", 6).alias("conf"))


def request_frame(spark, sf, **flags):
    """Verdict and aggregate scores per request; ``flags`` are made of the texts, which stay behind the join."""
    v = request_verdicts(spark, sf).select("req_id", "pred", "conf", "mal")
    a = aggregate_rows(spark, sf).select("req_id", F.col("enc"), F.col("dec").alias("raw"), F.col("dec").alias("norm"), F.lit(1).alias("depth"), "pscore")
    s = batch_scores(a, ["req_id", "enc", "raw", "pscore"], ["bctx", "kw_peak", "kw_best", "kw_Normal"])
    return v.join(s.select("req_id", "pscore", "bctx", "kw_peak", "kw_best", F.col("kw_Normal").alias("kw_n"), *[c.alias(n) for n, c in flags.items()]), "req_id")


@query("fus_request_benign_flip")
def _flip(spark, sf):
    low = F.lower("enc")
    shape = F.col("enc").contains("\u0000") | F.col("enc").rlike(R.PATTERNS["FULLWIDTH"])
    for x in ATTACK_SHAPES:
        shape = shape | low.contains(x)
    f = request_frame(spark, sf, shape=shape, only_hex=F.col("raw").rlike(R.PATTERNS["ONLY_P_HEX"]))
    hexed = F.col("only_hex") & ~F.col("bctx") & F.col("mal") & (F.col("conf") < 0.82)
    benign = F.col("bctx") & ~F.col("shape") & (~F.col("mal") | ((F.col("conf") < 0.80) & (F.col("conf") - F.round("kw_n", 6) < 0.60)))
    return f.select("req_id", F.when(hexed | benign, "Normal").otherwise(F.col("pred")).alias("verdict"), F.when(hexed, 0.82).when(benign, 0.88).otherwise(F.col("conf")).alias("conf"))


@query("fus_protocol_boost")
def _boost(spark, sf):
    f = request_frame(spark, sf)
    conf = F.least(F.lit(0.85), F.col("conf") + F.col("pscore") * 0.18)
    up = (F.col("pscore") >= 0.3) & ~F.col("mal") & ~F.col("bctx") & (F.round("kw_peak", 6) >= 0.18) & (conf >= 0.38)
    return f.select("req_id", F.when(up, F.col("kw_best")).otherwise(F.col("pred")).alias("verdict"), F.round(F.when(up, conf).otherwise(F.col("conf")), 6).alias("conf"))


@query("fus_request_report")
def _report(spark, sf):
    """Nested report: parts are an array built inside the request row, joined to its verdict."""
    r = requests(spark, sf)
    parts = D.merged_parts(F.col("url"), F.col("headers"), F.col("cookie"), F.col("body"), F.col("ctype"))
    v = request_verdicts(spark, sf).select("req_id", F.struct("pred", "conf", "mal", risk(F.col("pred"), F.col("conf")).alias("risk")).alias("detection"))
    rep = r.select("req_id", "method", "url", parts.alias("parts")).join(v, "req_id")
    return rep.select("req_id", "method", F.size("parts").alias("n_parts"), "detection.pred", "detection.risk")
