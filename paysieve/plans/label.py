"""Label job: label inference, signatures, small cascades, rule-table joins."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from paysieve.fixtures import local_table, payload_rows, table
from paysieve.functions import text as T
from paysieve.functions.labels import first_match, infer_label
from paysieve.operators.rule_index import bounded_rules, matching
from paysieve.plans.registry import query
from paysieve.plans.score import scored
from paysieve.session import evaluated_once, spread

# Signature table (cve, name, label, pattern, order).
SIGNATURES = [
    ("CVE-2021-44228", "Log4Shell JNDI", "CMD", r"(?i)\$\{jndi:(ldap|rmi|dns)://|%24%7[Bb]jndi|jndi\s*:\s*(ldap|rmi|dns)\s*://|\$\{\$\{(?:lower|upper):", r"\$\{jndi:(ldap|rmi|dns)://"),
    ("CVE-2022-22965", "Spring4Shell", "CMD", r"(?i)class\.module\.classLoader", r"class\.module\.classLoader"),
    ("CVE-2023-PROMPT", "LLM Prompt Leak", "PromptInjection", r"(?i)(ignore\s+(all\s+)?previous|reveal\s+system\s+prompt)", r"(ignore\s+(all\s+)?previous|reveal\s+system\s+prompt)"),
]


def patch_hits(spark, sf):
    """First decoded variant x first signature, as an ordered in-row choice (three signatures)."""
    df = payload_rows(spark, sf).withColumn("variants", T.decode_variants(F.col("payload")))
    hit = F.array_min(F.flatten(F.transform("variants", lambda v, i: F.array(*[F.when(v.rlike(s[3]), F.struct(i.alias("v"), F.lit(j).alias("c"))) for j, s in enumerate(SIGNATURES)]))))
    df = evaluated_once(df, "row_id", "label", "kind", hit=hit)
    pick = [first_match([(F.col("hit.c") == j, F.lit(s[f])) for j, s in enumerate(SIGNATURES)]) for f in (0, 1, 2, 4)]
    return df.select("row_id", "label", "kind", *[c.alias(n) for c, n in zip(pick, ("cve", "name", "verdict", "pattern"))])


@query("lab_virtual_patch")
def _vp(spark, sf):
    return patch_hits(spark, sf).select("row_id", "cve", "verdict")


@query("lab_patch_rule")
def _pr(spark, sf):
    h = patch_hits(spark, sf).filter("cve is not null")
    rule = F.format_string("# Virtual Patch %s\nSecRule ARGS \"@rx %s\" \"id:99001,phase:2,deny,msg:'VirtualPatch %s'\"", "cve", "pattern", "name")
    return h.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


@query("lab_infer")
def _infer(spark, sf):
    raw = first_match([(F.pmod("row_id", F.lit(4)) == 0, F.col("label")), (F.pmod("row_id", F.lit(4)) == 1, F.when(F.col("label") == "Normal", "norm").otherwise("anom"))], F.lit(""))
    return payload_rows(spark, sf).select("row_id", infer_label(F.col("payload"), raw).alias("value"))


@query("lab_concat_rescue")
def _concat(spark, sf):
    df = payload_rows(spark, sf)
    from paysieve.functions.scoring import add_scores
    from paysieve.plans.normalise import normalised
    df = df.withColumn("raw", F.regexp_replace("payload", "(?i)(un)(ion)|(scr)(ipt)|(sel)(ect)", "$1$3$5'+'$2$4$6")).select("row_id", "raw")
    df = add_scores(normalised(df, "raw"), "concat_label", "concat_conf")
    return df.select("row_id", F.col("concat_label").alias("verdict"), F.round(F.col("concat_conf").cast("double"), 6).alias("conf"))


@query("lab_atob_rescue")
def _atob(spark, sf):
    from paysieve.functions.scoring import add_scores
    from paysieve.plans.normalise import normalised
    wrapped = F.concat(F.lit("eval(atob('"), F.regexp_replace(F.base64(F.encode("payload", "UTF-8")), "\\s", ""), F.lit("'))"))
    df = payload_rows(spark, sf).select("row_id", F.when(F.pmod("row_id", F.lit(2)) == 0, wrapped).otherwise(F.col("payload")).alias("raw"))
    df = add_scores(normalised(df, "raw"), "atob_label", "atob_conf")
    return df.select("row_id", F.col("atob_label").alias("verdict"), F.round(F.col("atob_conf").cast("double"), 6).alias("conf"))


def risk(label, conf):
    return F.when(label == "Normal", "low").when(conf >= 0.85, "high").when(conf >= 0.6, "medium").otherwise("low")


@query("lab_risk_level")
def _risk(spark, sf):
    from paysieve.plans.evaluate import predictions
    return predictions(spark, sf).groupBy(F.col("pred"), risk(F.col("pred"), F.col("conf")).alias("risk")).agg(F.count("*").alias("n"))


@query("lab_tech_family")
def _fam(spark, sf):
    from paysieve.plans.evaluate import family
    return payload_rows(spark, sf).groupBy("kind", family(F.col("kind")).alias("family")).agg(F.count("*").alias("n"))


# Cluster signatures (pattern, name).
CLUSTERS = [(r"\$\{jndi|jndi:", "jndi"), (r"%2571%2564|%71%64", "mixed_pct_dynamic"), (r"set-?cookie", "crlf_cookie"), (r"passw%68|logina=", "malformed_form_cmd")]


def cluster_key(payload, label):
    low = F.lower(payload)
    pct = F.length(low) - F.length(F.replace(low, F.lit("%"), F.lit("")))
    tail = first_match([(low.rlike(p), F.lit(n)) for p, n in CLUSTERS] + [
        (pct >= 8, F.lit("high_pct_blob")), (low.contains("union") | low.contains("select"), F.lit("sqli_keywords")),
        (low.contains("<script") | low.contains("alert("), F.lit("xss_keywords"))], "other")
    return F.concat(label, F.lit(":"), tail)


@query("lab_cluster_key")
def _ck(spark, sf):
    return payload_rows(spark, sf).select("row_id", cluster_key(F.col("payload"), F.col("label")).alias("cluster"))


# Heuristics (pattern, template), then depth and mixed case.
TEMPLATES = [(r"%00|\\x00", "insert_null_byte"), (r"(?:%25){2,}", "repeat_url_encode"), (r"/\*.*?\*/", "deep_inline_comment"), ("[​-‍﻿]", "zero_width_inject"),
             (r"0x[0-9a-fA-F]{2,}", "hex_wrap_keywords"), (r"^[0-9a-fA-F]{32}$", "md5_hex32_camouflage")]


def inferred_templates(p):
    depth = T.encoding_depth(p)
    items = [F.when(p.rlike(r), F.lit(t)) for r, t in TEMPLATES]
    items += [F.when(depth >= 3, "repeat_url_encode").when(depth == 2, "double_url_encode_plus"), F.when((p != F.lower(p)) & (p != F.upper(p)), "mixed_case_burst")]
    return F.array_distinct(F.array_compact(F.array(*items)))


@query("lab_infer_templates")
def _it(spark, sf):
    return payload_rows(spark, sf).select("row_id", F.explode(inferred_templates(F.col("payload"))).alias("template"))


@query("lab_source_parts")
def _sp(spark, sf):
    p = payload_rows(spark, sf).select("source").unionByName(table(spark, sf, "documents").select("source"))
    pre = F.split_part("source", F.lit(":"), F.lit(1))
    kind = F.when(F.col("source").contains(":"), F.split_part("source", F.lit(":"), F.lit(2))).otherwise(F.col("source"))
    return p.groupBy(pre.alias("prefix"), kind.alias("obf_kind")).agg(F.count("*").alias("n"))


# --- rule table --------------------------------------------------------------------------------
# User data (rows of the rule table): priority, pattern, label, confidence, cluster, enabled.
RULES = [
    (0, r"set-?cookie", "SQLi", 0.72, "SQLi:crlf", True), (1, r"%252e%252e", "PathTraversal", 0.70, "PathTraversal:double", True),
    (2, r"jndi:", "CMD", 0.80, "CMD:jndi", True), (3, r"union\s+select", "SQLi", 0.75, "SQLi:union", True),
    (4, r"<script", "XSS", 0.75, "XSS:script", True), (5, r"etc/passwd", "PathTraversal", 0.74, "PathTraversal:passwd", True),
    (6, r"=", "SQLi", 0.50, "SQLi:other", False), (7, r"login=", "SQLi", 0.56, "SQLi:other", True),
]


def rule_table(spark):
    return local_table(spark, RULES, [("prio", pa.int64()), ("pattern", pa.string()), ("label", pa.string()), ("confidence", pa.float64()), ("cluster", pa.string()), ("enabled", pa.bool_())])


RULE = "array<struct<prio:bigint,pattern:string,label:string,confidence:double,cluster:string>>"


def match_rules(texts, rules):
    """First matching enabled rule per row, by priority.

    Only rules whose required literal may occur in a text are run on it (``rule_index``); the first hit is chosen inside
    the row, so no row x rule pairs are produced.
    """
    rows = sorted((r for r in bounded_rules(rules) if r.enabled), key=lambda r: r.prio)
    fields = ("prio", "pattern", "label", "confidence", "cluster")
    table_ = F.from_json(F.lit(json.dumps([{f: r[f] for f in fields} for r in rows])), RULE)
    hits = matching([r.pattern for r in rows], "raw_low_", "low")
    found = F.filter(F.transform(hits, lambda n: F.get(table_, n)), lambda r: ~(F.col("form") & (F.length("raw") > 35) & r["cluster"].endswith(":other")))
    return texts.withColumn("raw_low_", F.lower("raw")).withColumn("rule_", F.try_element_at(found, F.lit(1))).drop("raw_low_")


@query("lab_dynamic_rules")
def _dyn(spark, sf):
    t = evaluated_once(scored(spark, sf, "bform_raw_low", "low"), "row_id", "raw", low=F.col("low"), form=F.col("bform_raw_low"))
    return match_rules(t, rule_table(spark)).select("row_id", F.col("rule_.label").alias("verdict"), F.col("rule_.confidence").alias("conf"), F.col("rule_.cluster").alias("cluster"))


@query("jn_rules_regex")
def _jr(spark, sf):
    t = payload_rows(spark, sf).select("row_id", F.col("payload").alias("raw"), F.lower("payload").alias("low"), F.lit(False).alias("form"))
    return match_rules(t, rule_table(spark)).filter("rule_ is not null").select("row_id", F.col("rule_.prio").alias("prio"), F.col("rule_.label").alias("verdict"))


def rule_rates(texts, rules, key="prio"):
    """Hits of every rule over the texts and their share: rule numbers are counted per task, one row per rule is shuffled."""
    rows = bounded_rules(rules)
    # Number -1 counts the texts.
    counts = texts.select(F.explode(F.concat(F.array(F.lit(-1)), matching([r.pattern for r in rows], "low"))).alias("no")).groupBy("no").agg(F.count("*").alias("c"))
    per_rule = counts.agg(F.map_from_entries(F.collect_list(F.struct("no", "c"))).alias("counts"))
    numbered = rules.sparkSession.createDataFrame([(i, r[key]) for i, r in enumerate(rows)], f"no int, {key} {dict(rules.dtypes)[key]}")
    n, hits = F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)), F.coalesce(F.try_element_at("counts", F.col("no")), F.lit(0))
    return numbered.crossJoin(per_rule).select(key, n.alias("n"), hits.alias("hits"), F.round(hits / n, 6).alias("rate")).filter("n > 0")


@query("jn_fp_replay")
def _fpr(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(F.lower("text").alias("low"))
    pay = payload_rows(spark, sf).filter("label='Normal'").select(F.lower("payload").alias("low"))
    return rule_rates(docs.unionByName(pay), rule_table(spark)).select("prio", "n", "hits", "rate", (F.col("rate") > 0.02).alias("rejected"))


@query("udf_rule_table")
def _ur(spark, sf):
    t = payload_rows(spark, sf).select("row_id", "label", F.col("payload").alias("raw"), F.lower("payload").alias("low"), F.lit(False).alias("form")).withColumnRenamed("label", "truth")
    return match_rules(t, rule_table(spark)).filter("rule_ is not null").groupBy(F.col("rule_.cluster").alias("cluster"), "truth").agg(F.count("*").alias("n"))


@query("snk_rule_table")
def _sr(spark, sf):
    """Load the rule table, append only unseen patterns (from miss clusters), report totals."""
    return insert_rules(spark, sf).agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"))


def insert_rules(spark, sf):
    from paysieve.plans.evaluate import misses_raw
    new = misses_raw(spark, sf).groupBy(cluster_key(F.col("payload"), F.col("label")).alias("cluster"), "label").agg(F.min(F.lower("payload")).alias("lo"), F.max(F.lower("payload")).alias("hi"), F.count("*").alias("n"))
    new = new.select("label", "cluster", common_prefix(F.col("lo"), F.col("hi")).alias("pattern")).filter(F.length("pattern") >= 8)
    old = rule_table(spark).select("pattern", "label", "confidence", "cluster", "enabled")
    bounded_rules(old)  # the stored table is within its bounds, so it can be broadcast
    fresh = new.join(F.broadcast(old.select("pattern")), "pattern", "left_anti").select("pattern", "label", F.lit(0.60).alias("confidence"), "cluster", F.lit(True).alias("enabled"))
    return old.unionByName(fresh)


@query("set_rule_insert")
def _si(spark, sf):
    return insert_rules(spark, sf)


def common_prefix(a, b):
    """Longest common prefix of a set equals that of its smallest and largest member."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))))
    return F.trim(F.substr(a, F.lit(1), same))


@query("agg_common_prefix")
def _cp(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.min(F.lower("text")).alias("lo"), F.max(F.lower("text")).alias("hi")).select(F.lit("doc").alias("origin"), F.col("source").alias("grp"), "lo", "hi")
    p = payload_rows(spark, sf).groupBy(F.concat_ws("/", "label", F.pmod("row_id", F.lit(64)).cast("string")).alias("grp")).agg(F.min(F.lower("payload")).alias("lo"), F.max(F.lower("payload")).alias("hi")).select(F.lit("payload").alias("origin"), "grp", "lo", "hi")
    both = d.unionByName(p).select("origin", "grp", common_prefix(F.col("lo"), F.col("hi")).alias("prefix"))
    return both.select("origin", "grp", F.when(F.length("prefix") >= 8, F.col("prefix")).otherwise("").alias("prefix"))


@query("agg_miss_clusters")
def _mc(spark, sf):
    """Clusters of misses, derived pattern, benign replay rate, register / reject report."""
    from paysieve.plans.evaluate import misses_raw
    c = misses_raw(spark, sf).groupBy(cluster_key(F.col("payload"), F.col("label")).alias("cluster")).agg(F.count("*").alias("n"), F.min(F.lower("payload")).alias("lo"), F.max(F.lower("payload")).alias("hi"))
    c = c.withColumn("pattern", common_prefix(F.col("lo"), F.col("hi")))
    quoted = c.filter(F.length("pattern") >= 8).select("cluster", F.concat(F.lit("\\Q"), "pattern", F.lit("\\E")).alias("pattern"))
    benign = payload_rows(spark, sf).filter("label='Normal'").select(F.lower("payload").alias("low"))
    r = c.join(rule_rates(benign, quoted, "cluster").select("cluster", "rate"), "cluster", "left")
    status = F.when(F.length("pattern") < 8, "no_pattern").when(F.col("rate") > 0.02, "rejected").otherwise("registered")
    return r.select("cluster", "n", F.when(F.length("pattern") >= 8, F.col("pattern")).otherwise("").alias("pattern"), F.col("rate"), status.alias("status"))
