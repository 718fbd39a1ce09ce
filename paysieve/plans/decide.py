"""Score / label / decide queries and the flagship request verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paysieve.fixtures import payload_rows, requests
from paysieve.functions import features as X
from paysieve.functions import rules as R
from paysieve.functions.scoring import VIEW_NAMES, add_scores, add_view_scores, batch_scores, score_views
from paysieve.operators import decompose as D
from paysieve.operators.decide import add_series, decide_parts, reduce_requests
from paysieve.plans.normalise import normalised
from paysieve.plans.registry import query
from paysieve.session import cut_lineage


def base_rows(spark, sf):
    return normalised(payload_rows(spark, sf)).withColumn("raw", F.col("payload"))


def vector_query(key, prefix, labels=R.LABELS):
    @query(key)
    def _run(spark, sf):
        cols = [f"{prefix}_{k}" for k in labels]
        return decide_parts(base_rows(spark, sf), ["row_id"], *cols).select("row_id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in cols])


def decision_query(key, p):
    @query(key)
    def _run(spark, sf):
        cols = [f"{p}_label", f"{p}_conf", f"{p}_mal"]
        return decide_parts(base_rows(spark, sf), ["row_id"], *cols).select("row_id", F.col(cols[0]).alias("verdict"), F.round(F.col(cols[1]).cast("double"), 5).alias("conf"), F.col(cols[2]).alias("mal"))


for _k, _p in [("sco_semantic_boost", "sb"), ("sco_protocol_bias", "pro"), ("sco_vision_bias", "vis"), ("sco_multimodal", "mm"), ("fus_late_fusion", "lf"), ("fus_obf_boost", "ob")]:
    vector_query(_k, _p)
for _k, _p in [("fus_base_predict", "base"), ("fus_threshold", "th"), ("fus_fallback", "fb"), ("fus_fp_guard", "gd"), ("fus_benign_override", "ov"), ("lab_semantic_tiebreak", "fin")]:
    decision_query(_k, _p)


@query("lab_arbitrate")
def _arb(spark, sf):
    return decide_parts(base_rows(spark, sf), ["row_id"], "ar_label", "ar_conf").select("row_id", F.col("ar_label").alias("verdict"), F.round(F.col("ar_conf").cast("double"), 5).alias("conf"))


@query("fus_calibrated_weights")
def _cal(spark, sf):
    cols = ["cw_base", "cw_sem", "cw_mm", "cw_dl"]
    df = decide_parts(base_rows(spark, sf), [], "obf", *cols)
    return df.groupBy("obf").agg(F.count("*").alias("n"), *[F.round(F.max(c), 6).alias(c) for c in cols])


@query("fus_gate")
def _gate(spark, sf):
    cols = ["w_base", "w_sem", "w_mm", "w_dl"]
    return decide_parts(base_rows(spark, sf), ["row_id"], *cols).select("row_id", *[F.round(c, 6).alias(c) for c in cols])


@query("sco_semantic_kw")
def _semkw(spark, sf):
    df = add_scores(base_rows(spark, sf), *[f"sem_{k}" for k in R.LABELS], "low")
    tokens = F.regexp_extract_all("low", F.lit("[a-z]{3,}"), F.lit(0))
    df = df.withColumn("tokens", tokens).withColumn("hits", F.size(F.filter("tokens", lambda t: t.isin(R.MARKERS["SUSPICIOUS"]))))
    return df.select("row_id", *[F.round(F.col(f"sem_{k}").cast("double"), 5).alias(f"sem_{k}") for k in R.LABELS], F.col("hits").cast("bigint").alias("hits"),
                     F.round(F.col("hits") / F.greatest(F.size("tokens"), F.lit(1)), 6).alias("density"))


@query("sco_semantic_views")
def _views(spark, sf):
    df = add_view_scores(base_rows(spark, sf))
    return df.select("row_id", *[F.round(F.col(f"vs_{k}").cast("double"), 5).alias(f"vs_{k}") for k in R.ATTACKS], "view_label", F.round(F.col("view_conf").cast("double"), 5).alias("view_conf"))


@query("nrm_semantic_views")
def _nviews(spark, sf):
    df = score_views(base_rows(spark, sf))
    return df.select("row_id", *[F.replace(f"v_{v}", F.lit("\u0000"), F.lit("<NUL>")).alias(f"v_{v}") for v in VIEW_NAMES])


@query("prd_parser_discrepancy")
def _disc(spark, sf):
    return add_view_scores(base_rows(spark, sf)).select("row_id", F.col("discrepant").alias("flag"))


@query("win_pseudo_series")
def _pseudo(spark, sf):
    df = add_series(base_rows(spark, sf), F.lit("query"))
    return df.select("row_id", *[F.round(c, 5).alias(c) for c in ("resid", "slope", "third", "anom")])


# --- request verdicts ---------------------------------------------------------------------------
def benign_fast_path() -> Column:
    """Entry gate: plain short texts, and longer ones without any prior of an attack, need no cascade."""
    simple = (F.length("raw") <= 16) & ~F.col("raw").rlike(r"[^\x00-\x7F]") & (X.count_char(F.col("raw"), "%") < 2)
    return ~F.col("obf") & ~F.col("strong") & ~F.col("hexw") & (F.col("depth") < 2) & (simple | ((F.round("rp_peak", 6) < 0.22) & (F.length("raw") < 120)))


def gated_verdicts(rows, *same):
    """Rows (raw, norm, depth, location and the columns ``same``) with the fused label, confidence and malicious flag of the cascade.

    The gate splits the rows once: it is evaluated in one pass whose result keeps the texts of the rows that need the
    cascade and only the verdict of the others (Normal, with their keyword score).  The cascade then reads the former alone.
    """
    df = batch_scores(rows, [*same, "raw", "norm", "depth"], ["obf", "strong", "hexw", "rp_peak", "kw_Normal"])
    df = df.withColumns({"gate": benign_fast_path(), "plain": F.round(F.col("kw_Normal").cast("double"), 6)})
    text = lambda c: F.when(~F.col("gate"), F.col(c)).alias(c)
    split = cut_lineage(df.select(*same, "depth", "gate", "plain", text("raw"), text("norm")))
    found = decide_parts(split.filter("NOT gate"), list(same), "fin_label", "fin_conf", "fin_mal", location=F.col("location"))
    costly = found.select(*same, F.col("fin_label").alias("pred"), F.col("fin_mal").alias("mal"), F.round(F.col("fin_conf").cast("double"), 6).alias("conf"))
    cheap = split.filter("gate").select(*same, F.lit("Normal").alias("pred"), F.lit(False).alias("mal"), F.col("plain").alias("conf"))
    return costly.unionByName(cheap)


def part_verdicts(spark, sf, *keys):
    """Parts of all requests with their fused verdict."""
    parts = D.request_parts(requests(spark, sf), *keys)
    return gated_verdicts(normalised(parts, "raw"), "req_id", "pos", "location", *keys)


def request_verdicts(spark, sf):
    return reduce_requests(part_verdicts(spark, sf, "ts", "src", "label", "kind"), "ts", "src", "label", "kind")


@query("flagship")
def _flag(spark, sf):
    """Per true class: requests, recall, exact-class recall and mean confidence, with the overall FPR on Normal."""
    v = request_verdicts(spark, sf)
    return v.groupBy("label").agg(
        F.count("*").alias("n_requests"), F.count_if("mal").alias("flagged"), F.count_if(F.col("pred") == F.col("label")).alias("exact"),
        F.round(F.count_if("mal") / F.count("*"), 4).alias("flag_rate"), F.round(F.avg("conf"), 4).alias("avg_conf"))


@query("fus_request_reduce")
def _reduce(spark, sf):
    return request_verdicts(spark, sf).select("req_id", "pred", "conf", "mal", "location")


@query("job_decide_summary")
def _dsum(spark, sf):
    v = request_verdicts(spark, sf)
    return v.groupBy("pred", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.count_if("mal").alias("flagged"))
