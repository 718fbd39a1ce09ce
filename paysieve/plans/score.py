"""Featurise / score / label jobs over normalised payload rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.fixtures import payload_rows
from paysieve.functions import rules as R
from paysieve.functions.scoring import add_scores, add_view_scores
from paysieve.plans.normalise import normalised
from paysieve.plans.registry import query


def scored(spark, sf, *wanted, stages=None):
    df = normalised(payload_rows(spark, sf)).withColumn("raw", F.col("payload"))
    return add_scores(df, *wanted, stages=stages)


def rounded(prefix: str, digits: int = 6):
    return [F.round(F.col(f"{prefix}_{k}").cast("double"), digits).alias(f"{prefix}_{k}") for k in R.LABELS]


def score_query(key: str, prefix: str, labels=R.LABELS):
    @query(key)
    def _run(spark, sf):
        cols = [f"{prefix}_{k}" for k in labels]
        return scored(spark, sf, *cols).select("row_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in cols])


score_query("sco_keyword", "kw")
score_query("sco_structural", "st")
score_query("sco_evasion", "ev", R.ATTACKS)
score_query("sco_rule_prior", "rp")


@query("sco_xxe")
def _xxe(spark, sf):
    return scored(spark, sf, "xxe").select("row_id", F.round("xxe", 6).alias("xxe"))


def flag_query(key: str, column: str):
    @query(key)
    def _run(spark, sf):
        return scored(spark, sf, column).select("row_id", "label", "kind", F.col(column).alias("flag"))


for _key, _col in [("prd_is_obfuscated", "obf"), ("prd_strong_obf", "strong"), ("prd_encoded_cmd", "cmd_raw_low"), ("prd_fullwidth", "fw"),
                   ("prd_unicode_sqli", "uni_sig"), ("prd_case_param", "casep"), ("prd_benign_form", "bform_raw_low"),
                   ("prd_benign_address", "baddr_raw_low"), ("prd_benign_context", "bctx"), ("prd_pct_address", "pp_raw_low"),
                   ("prd_html_entity_xss", "entity_xss")]:
    flag_query(_key, _col)


def verdict_query(key: str, name: str):
    @query(key)
    def _run(spark, sf):
        return scored(spark, sf, f"{name}_label", f"{name}_conf").select(
            "row_id", F.col(f"{name}_label").alias("verdict"), F.round(F.col(f"{name}_conf").cast("double"), 6).alias("conf"))


verdict_query("lab_xxe_rescue", "xxe")
verdict_query("lab_rescue", "rescue")
