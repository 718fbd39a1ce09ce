"""DuckDB text for the score job."""

from oracles.scoring import scored_payloads
from paysieve.functions import rules as R


def vec(prefix, labels=R.LABELS):
    cols = [f"{prefix}_{k}" for k in labels]
    return scored_payloads("SELECT row_id, " + ", ".join(f"round({c}::DOUBLE,6) AS {c}" for c in cols) + " FROM sc", *cols)


def flag(col):
    return scored_payloads(f"SELECT row_id, label, kind, {col} AS flag FROM sc", col)


def verdict(name):
    return scored_payloads(f"SELECT row_id, {name}_label AS verdict, round({name}_conf::DOUBLE,6) AS conf FROM sc", f"{name}_label", f"{name}_conf")


SQL = {
    "sco_keyword": vec("kw"), "sco_structural": vec("st"), "sco_evasion": vec("ev", R.ATTACKS), "sco_rule_prior": vec("rp"),
    "sco_xxe": scored_payloads("SELECT row_id, round(xxe,6) AS xxe FROM sc", "xxe"),
    "lab_xxe_rescue": verdict("xxe"), "lab_rescue": verdict("rescue"),
    **{k: flag(c) for k, c in [("prd_is_obfuscated", "obf"), ("prd_strong_obf", "strong"), ("prd_encoded_cmd", "cmd_raw_low"), ("prd_fullwidth", "fw"),
                   ("prd_unicode_sqli", "uni_sig"), ("prd_case_param", "casep"), ("prd_benign_form", "bform_raw_low"),
                   ("prd_benign_address", "baddr_raw_low"), ("prd_benign_context", "bctx"), ("prd_pct_address", "pp_raw_low"),
                   ("prd_html_entity_xss", "entity_xss")]},
}
