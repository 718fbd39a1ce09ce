"""Evaluate job: predictions, feedback, metrics, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paysieve.fixtures import payload_rows, table
from paysieve.functions import features as X
from paysieve.functions.labels import first_match, infer_label
from paysieve.operators.metrics import binary, ratio
from paysieve.operators.scale import md5_number
from paysieve.plans.normalise import normalised
from paysieve.plans.registry import query
from paysieve.session import cut_lineage, evaluated_once



def predictions(spark, sf):
    """Payload rows with a decoded verdict (pred, conf) and an undecoded one (pred0)."""
    df = normalised(payload_rows(spark, sf))
    special = F.regexp_count("norm", F.lit(r"[^\p{L}\p{N}]")) / F.greatest(F.length("norm"), F.lit(1))
    pred = infer_label(F.col("norm"))
    df = evaluated_once(df, "row_id", "ts", "src", "payload", "label", "kind", "source", norm=F.col("norm"), depth=F.col("depth"), pred=pred, pred0=infer_label(F.col("payload")), special=special)
    return df.withColumn("conf", F.round(F.when(F.col("pred") == "Normal", 1 - 0.5 * F.col("special")).otherwise(
        F.least(F.lit(0.99), 0.55 + 0.08 * F.col("depth") + 0.4 * F.col("special"))), 4))


TIER_CUT = (10, 15)


def source_bucket(key):
    return F.pmod(md5_number(key), F.lit(100))


def traffic_tier(key, canary: int = TIER_CUT[0]):
    b = source_bucket(key)
    return F.when(b < canary, "canary").when(b < min(100, canary + 5), "shadow").otherwise("stable")


def reward():
    return F.when(F.col("pred") == F.col("label"), 1.0).when((F.col("pred") != "Normal") & (F.col("label") != "Normal"), -0.5).otherwise(-1.0)


def feedback(spark, sf):
    p = predictions(spark, sf)
    return p.select(F.col("row_id").alias("seq"), "ts", "src", traffic_tier(F.col("src")).alias("tier"), F.col("pred").alias("predicted"), F.col("label").alias("true_label"), reward().alias("reward"), "payload")




@query("agg_binary_metrics")
def _bin(spark, sf):
    """Documents: truth = quality label, prediction = text rule (entropy and special-character bounds)."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    t = F.col("text")
    pred = (F.round(X.entropy(t), 6) < 4.3) & (F.regexp_count(t, F.lit(r"[^\p{L}\p{N}]")) / F.greatest(F.length(t), F.lit(1)) < 0.25)
    rows = evaluated_once(docs, "doc_id", truth=F.col("quality") == 1, pred=pred)
    return rows.agg(*[c.alias(n) for n, c in binary(F.col("truth"), F.col("pred")).items()])


@query("agg_multiclass")
def _multi(spark, sf):
    return predictions(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 4).alias("accuracy"), ratio(F.count_if((F.col("label") != "Normal") & (F.col("pred") == F.col("label"))), F.count_if((F.col("label") != "Normal"))).alias("exact_recall"))


@query("agg_subset_metrics")
def _subset(spark, sf):
    """All rows, obfuscated attacks and normals from one pass."""
    p = predictions(spark, sf)
    parts = {"all": F.lit(True), "obfuscated": (F.col("label") != "Normal") & (F.col("kind") != "plain"), "normal": ~(F.col("label") != "Normal")}
    cols = [c.alias(f"{s}_{n}") for s, w in parts.items() for n, c in binary((F.col("label") != "Normal"), (F.col("pred") != "Normal"), w).items() if n in ("tp", "fp", "fn", "tn", "recall", "fpr")]
    return p.agg(*cols)


@query("agg_recall_buckets")
def _buckets(spark, sf):
    p = predictions(spark, sf).filter((F.col("label") != "Normal")).withColumn("family", family(F.col("kind")))
    p.createOrReplaceTempView("paysieve_preds")
    return spark.sql("""SELECT coalesce(kind,'*') AS kind, coalesce(label,'*') AS label, coalesce(family,'*') AS family, count(*) AS total, count_if(pred<>'Normal') AS detected,
        count_if(pred=label) AS exact, round(count_if(pred<>'Normal')/count(*),4) AS recall, round(count_if(pred=label)/count(*),4) AS exact_recall
        FROM paysieve_preds GROUP BY GROUPING SETS ((kind),(label),(family))""")


def family(c):
    """Technique name to family by substring, first hit wins."""
    # Substrings per family.
    table_ = [("encoding", "url|unicode|hex|base64|entity|encoding|charcode"), ("parser", "json|multipart|boundary|xinclude|proxy"),
              ("structure", "comment|concat|split|whitespace|paren|operator|tautology"), ("command", "ifs|brace|wildcard|cmd"), ("xss", "svg|img|data_uri|ontoggle|xss")]
    return first_match([(c.rlike(p), F.lit(n)) for n, p in table_], "semantic")


def shares(df, *keys):
    """Counts per key with the share of the total; the total is a one-row aggregate of the counts."""
    c = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.crossJoin(F.broadcast(total)).select(*keys, "n", F.round(F.col("n") / F.col("t") * 100, 2).alias("pct"))


def misses(spark, sf):
    return predictions(spark, sf).filter((F.col("label") != "Normal") & (F.col("pred") == "Normal"))


@query("agg_miss_counts")
def _miss(spark, sf):
    m = misses(spark, sf).withColumns({"prefix": F.split_part("source", F.lit(":"), F.lit(1)), "pattern": miss_pattern()})
    m.createOrReplaceTempView("paysieve_miss")
    return spark.sql("""SELECT dim, val, n, round(n*100.0/sum(n) OVER (PARTITION BY dim),2) AS pct FROM (
        SELECT CASE WHEN grouping(label)=0 THEN 'label' WHEN grouping(source)=0 THEN 'source' WHEN grouping(prefix)=0 THEN 'prefix' ELSE 'pattern' END AS dim,
        coalesce(label,source,prefix,pattern) AS val, count(*) AS n FROM paysieve_miss GROUP BY GROUPING SETS ((label),(source),(prefix),(pattern)))""").withColumn("pct", F.col("pct").cast("double"))


def miss_pattern():
    pl, k = F.lower("payload"), F.split_part("source", F.lit(":"), F.lit(2))
    cmd = F.col("label") == "CMD"
    return first_match([
        ((k == "double_url") | pl.contains("%252"), F.when(cmd, "double_url_encode_cmd").otherwise("double_url_encode_sqli")),
        ((k == "null_byte") | pl.contains("%00"), F.lit("null_byte_in_params")),
        ((k == "unicode") | F.col("payload").rlike(r"\\u[0-9a-fA-F]{4}"), F.lit("unicode_escape_sqli")),
        ((k == "multipart") | pl.contains("webkitformboundary"), F.when(cmd, "multipart_boundary_cmd").otherwise("multipart_boundary_sqli")),
        ((k == "url") & pl.rlike("echo|str=|str%3d"), F.lit("url_encode_cmd")),
        (k == "base64", F.lit("base64_fragment_sqli")), (k == "case", F.lit("case_random_cmd")), (k == "fullwidth", F.lit("unicode_normalization")),
    ], F.concat(F.lit("other:"), k))


@query("lab_miss_pattern")
def _mp(spark, sf):
    return payload_rows(spark, sf).select("row_id", miss_pattern().alias("pattern"))


@query("top_miss_patterns")
def _tmp(spark, sf):
    m = evaluated_once(misses(spark, sf), "row_id", pattern=miss_pattern())
    return shares(m, "pattern").orderBy(F.desc("n"), "pattern").limit(10)


@query("agg_crosstab")
def _cross(spark, sf):
    d = table(spark, sf, "documents").withColumn("prefix", F.regexp_extract("source", "^(src[0-9])", 1))
    return d.groupBy("lang").pivot("prefix", [f"src{i}" for i in range(10)]).count().na.fill(0)


@query("agg_score_histogram")
def _hist(spark, sf):
    p = predictions(spark, sf)
    return p.groupBy(F.floor(F.round(F.col("conf") * 10000) / 100).alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bin").limit(10)


@query("agg_fallback_coverage")
def _cover(spark, sf):
    """Share of misses that the undecoded marker rule would catch, overall and for the five largest patterns."""
    m = evaluated_once(misses(spark, sf), "row_id", pattern=miss_pattern(), hit=F.col("payload").rlike(r"%|\\u|&#|0x"))
    per = m.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    top5 = per.orderBy(F.desc("n"), "pattern").limit(5)
    rows = per.withColumn("scope", F.lit("all")).unionByName(top5.withColumn("scope", F.lit("top5")))
    return rows.groupBy("scope").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.round(F.sum("hits") / F.sum("n"), 4).alias("share"))


def fp_category():
    low = F.lower("payload")
    return first_match([
        (low.rlike("modo=|login=|password=|usuario=|clave="), F.lit("login_form_other")), (low.rlike("%2[0-9a-f]{2}"), F.lit("url_encoded")),
        (low.rlike(r"<script|onerror|alert\("), F.lit("xss_like")), (low.rlike(r"union|select|insert|or\s+1"), F.lit("sqli_like")), (low.rlike(r"\.\./|etc/passwd"), F.lit("path_like")),
        (low.rlike("webkitformboundary|multipart"), F.lit("multipart_like")), (F.length("payload") > 500, F.lit("long_payload"))], F.concat(F.lit("other_"), F.col("pred")))


@query("lab_fp_category")
def _fpc(spark, sf):
    return predictions(spark, sf).select("row_id", fp_category().alias("category"))


@query("agg_fp_report")
def _fpr(spark, sf):
    p = evaluated_once(predictions(spark, sf).filter(~(F.col("label") != "Normal")), "row_id", "pred", category=fp_category(), hit=(F.col("pred") != "Normal") | (F.col("conf") < 0.9))
    return p.groupBy("category", "pred").agg(F.count("*").alias("n"), F.count_if("hit").alias("flagged"), F.round(F.count_if("hit") / F.count("*"), 4).alias("fpr"))


CRS = [  # Fixed values: baseline signature ids and patterns.
    ("942100", r"(?is)select\s+.+\s+from"), ("942110", r"(?i)union\s+(all\s+)?select"), ("942120", r"(?i)(?:/\*!?|\*/|--\s|#)"), ("942130", r"(?i)'\s*(?:or|and)\s+'?\d"),
    ("942140", r"(?i)'\s*or\s+'[^']*'\s*=\s*'"), ("942150", r"(?i)(?:concat|group_concat|char\s*\(|0x[0-9a-f]{4,})"), ("942160", r"(?i)(?:sleep\s*\(|benchmark\s*\(|waitfor\s+delay)"),
    ("942170", r"(?i)(?:information_schema|sys\.|pg_catalog)"), ("942180", r"(?i)(?:into\s+(?:outfile|dumpfile)|load_file\s*\()"), ("942190", r"(?i)(?:;\s*(?:drop|delete|insert|update|alter)\s+)"),
    ("941100", r"(?i)<script[\s>]"), ("941110", r"(?i)(?:javascript|vbscript)\s*:"), ("941120", r"(?i)on(?:error|load|click|mouse)\s*="), ("941130", r"(?i)<\s*(?:iframe|object|embed|svg)"),
    ("941140", r"(?i)(?:alert\s*\(|prompt\s*\(|confirm\s*\()"), ("932100", r"(?i)(?:\|\s*(?:cat|ls|id|whoami|uname)\b|;\s*(?:cat|ls|id)\b)"), ("932110", r"(?i)(?:\$\([^)]+\)|`[^`]+`|\|\|)"),
    ("932120", r"(?i)(?:&&\s*(?:echo|wget|curl)|;\s*(?:wget|curl)\s+)"), ("932130", r"(?i)(?:/bin/(?:sh|bash)|cmd\.exe|powershell)")]


def crs_hits():
    from paysieve.functions.text import url_percent
    dec = url_percent(F.col("payload"))
    return F.array_compact(F.array(*[F.when(dec.rlike(p) | F.col("payload").rlike(p), F.lit(i)) for i, p in CRS]))


def crs_rows(spark, sf):
    df = evaluated_once(payload_rows(spark, sf), "row_id", "label", hits=crs_hits())
    lab = first_match([(F.size("hits") == 0, F.lit("Normal"))] + [(F.array_join("hits", ",").rlike(f"(?:^|,){p}"), F.lit(n)) for p, n in (("942", "SQLi"), ("941", "XSS"), ("932", "CMD"))], "SQLi")
    return df.withColumn("crs", lab)


@query("lab_crs_rules")
def _crs(spark, sf):
    return crs_rows(spark, sf).select("row_id", F.array_join("hits", ",").alias("hits"), "crs")


@query("agg_top_rules")
def _rules(spark, sf):
    return crs_rows(spark, sf).select(F.explode("hits").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(15)


@query("agg_baseline_compare")
def _cmp(spark, sf):
    p = predictions(spark, sf).withColumn("hits", crs_hits())
    rows = p.select("label", F.explode(F.array(F.struct(F.lit("engine").alias("detector"), (F.col("pred") != "Normal").alias("hit")), F.struct(F.lit("baseline").alias("detector"), (F.size("hits") > 0).alias("hit")))).alias("d")).select("label", "d.*")
    return rows.groupBy("detector").agg(ratio(F.count_if((F.col("label") != "Normal") & F.col("hit")), F.count_if((F.col("label") != "Normal"))).alias("recall"), ratio(F.count_if(~(F.col("label") != "Normal") & F.col("hit")), F.count_if(~(F.col("label") != "Normal"))).alias("fpr"))


def rounds(spark, sf):
    """Events per day as rounds: error events count as missed."""
    e = table(spark, sf, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("round")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("missed")) \
        .withColumn("recall", F.round((F.col("total") - F.col("missed")) / F.col("total"), 4))


def drift(df):
    r = F.col("recall")
    return df.agg(F.count("*").alias("n"), F.round(F.avg(r), 4).alias("mean"), F.round(F.stddev_pop(r), 4).alias("std"), F.min(r).alias("low"), F.max(r).alias("high"), F.round(F.max(r) - F.min(r), 4).alias("spread"),
                  F.min_by(r, "round").alias("first"), F.max_by(r, "round").alias("last"), F.round(F.max_by(r, "round") - F.min_by(r, "round"), 4).alias("delta"))


@query("agg_drift")
def _drift(spark, sf):
    return drift(rounds(spark, sf))


@query("agg_converged")
def _conv(spark, sf):
    return drift(rounds(spark, sf)).select("n", ((F.col("mean") >= 0.7) & (F.col("last") >= 0.7) & (F.col("std") <= 0.1) & (F.col("spread") <= 0.3)).alias("converged"))


@query("agg_round_recall")
def _rr(spark, sf):
    e = table(spark, sf, "events").withColumn("round", F.date_trunc("day", "ts"))
    per = e.groupBy("round", "event_type").agg(F.count("*").alias("n"))
    return per.groupBy("round").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)).alias("missed"),
                                    F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string")))), ",").alias("by_type"))


@query("agg_block_label_recall")
def _block(spark, sf):
    p = predictions(spark, sf).filter((F.col("label") != "Normal")).withColumn("round", F.pmod("row_id", F.lit(3)))
    return p.rollup("round").agg(F.count("*").alias("n"), ratio(F.count_if((F.col("pred") != "Normal")), F.count("*")).alias("block_recall"), ratio(F.count_if(F.col("pred") == F.col("label")), F.count("*")).alias("label_recall")).withColumn("round", F.coalesce("round", F.lit(-1)))


@query("agg_seed_median")
def _seed(spark, sf):
    e = table(spark, sf, "events").groupBy(F.pmod("user_id", F.lit(7)).alias("seed")).agg(F.round(F.count_if(F.col("event_type") != "error") / F.count("*"), 6).alias("recall"))
    return e.agg(F.round(F.median("recall"), 4).alias("median"), F.round(F.avg("recall"), 4).alias("mean"), F.round(F.min("recall"), 4).alias("low"), F.round(F.max("recall"), 4).alias("high"))


@query("agg_recovery")
def _rec(spark, sf):
    """Former misses of the undecoded verdict, recovered by the decoded one."""
    m = predictions(spark, sf).filter((F.col("label") != "Normal") & (F.col("pred0") == "Normal"))
    return m.groupBy("kind").agg(F.count("*").alias("total"), F.count_if((F.col("pred") != "Normal")).alias("recovered"), ratio(F.count_if((F.col("pred") != "Normal")), F.count("*")).alias("rate"), (F.count("*") == 0).alias("vacuous"))


def configs(spark, sf):
    p = predictions(spark, sf)
    cfg = F.explode(F.array(F.struct(F.lit("full").alias("config"), F.col("pred").alias("p")), F.struct(F.lit("no_decode").alias("config"), F.col("pred0").alias("p")),
                            F.struct(F.lit("depth1").alias("config"), F.when(F.col("depth") <= 1, F.col("pred")).otherwise(F.col("pred0")).alias("p"))))
    return p.select("label", "kind", cfg.alias("c")).select("label", "kind", "c.*")


@query("agg_ablation_delta")
def _abl(spark, sf):
    m = configs(spark, sf).groupBy("config").agg(ratio(F.count_if((F.col("label") != "Normal") & (F.col("kind") != "plain") & (F.col("p") != "Normal")), F.count_if((F.col("label") != "Normal") & (F.col("kind") != "plain"))).alias("recall"), ratio(F.count_if(~(F.col("label") != "Normal") & (F.col("p") != "Normal")), F.count_if(~(F.col("label") != "Normal"))).alias("fpr"))
    full = m.filter("config='full'").select(F.col("recall").alias("r0"), F.col("fpr").alias("f0"))
    return m.crossJoin(F.broadcast(full)).select("config", "recall", "fpr", F.round(F.col("recall") - F.col("r0"), 4).alias("d_recall"), F.round(F.col("fpr") - F.col("f0"), 4).alias("d_fpr"))


@query("agg_mm_delta")
def _mm(spark, sf):
    m = configs(spark, sf).filter(F.col("config").isin("full", "no_decode"))
    per = m.groupBy("label").pivot("config", ["full", "no_decode"]).agg(F.avg((F.col("p") != "Normal").cast("double")))
    return per.select("label", F.round("full", 4).alias("on_rate"), F.round("no_decode", 4).alias("off_rate"), F.round((F.col("full") - F.col("no_decode")) * 100, 2).alias("delta_pp"))


@query("agg_latency")
def _lat(spark, sf):
    """Every figure comes from one histogram of values: no percentile state or sorted task holds them all."""
    hist = cut_lineage(table(spark, sf, "events").select(F.col("value").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c")))

    def at(index):
        return F.min(F.when(F.col("upto") > index, F.col("v")))

    def between(p):
        place = (F.col("all_") - 1) * p
        return at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
    i99 = F.floor(F.col("all_") * 0.99)
    (lo50, hi50, w50), (lo95, hi95, w95) = between(0.5), between(0.95)
    return cumulative(hist).agg(F.sum("c").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 4).alias("mean"), F.round(lo50 + (hi50 - lo50) * w50, 4).alias("p50"), F.round(lo95 + (hi95 - lo95) * w95, 4).alias("p95"),
                                F.max("v").alias("top"), at(F.least(i99, F.col("all_") - 1)).alias("p99"), at(F.floor(i99 * 0.99)).alias("p99_trimmed"))


def cumulative(hist):
    """Running counts over the value order in two levels: a bounded number of value ranges, then inside a range."""
    span = hist.agg(F.min("v").alias("lo_"), F.max("v").alias("hi_"))
    h = hist.crossJoin(F.broadcast(span)).withColumn("b_", F.floor((F.col("v") - F.col("lo_")) / F.greatest(F.col("hi_") - F.col("lo_"), F.lit(1e-9)) * 4096))
    per = h.groupBy("b_").agg(F.sum("c").alias("bc"))
    per = per.withColumn("before_", F.sum("bc").over(Window.orderBy("b_")) - F.col("bc")).withColumn("all_", F.sum("bc").over(Window.partitionBy()))
    return h.join(F.broadcast(per), "b_").withColumn("upto", F.col("before_") + F.sum("c").over(Window.partitionBy("b_").orderBy("v"))).select("v", "c", "upto", "all_")


@query("agg_attack_distribution")
def _dist(spark, sf):
    recent = predictions(spark, sf).filter((F.col("pred") != "Normal")).orderBy(F.desc("ts"), F.desc("row_id")).limit(50)
    return recent.groupBy("pred").agg(F.count("*").alias("n"))


@query("snk_alerts")
def _alerts(spark, sf):
    return predictions(spark, sf).filter((F.col("pred") != "Normal")).orderBy(F.desc("ts"), F.desc("row_id")).limit(20).select("row_id", "ts", "pred", "conf")


@query("agg_reward_summary")
def _rew(spark, sf):
    return feedback(spark, sf).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 4).alias("mean"), F.count_if(F.col("reward") > 0).alias("positive"), F.count_if(F.col("reward") < 0).alias("negative"))


@query("agg_calibration")
def _calib(spark, sf):
    p = predictions(spark, sf).agg(ratio(F.count_if((F.col("label") != "Normal") & (F.col("kind") != "plain") & (F.col("pred") != "Normal")), F.count_if((F.col("label") != "Normal") & (F.col("kind") != "plain"))).alias("recall"), ratio(F.count_if(~(F.col("label") != "Normal") & (F.col("pred") != "Normal")), F.count_if(~(F.col("label") != "Normal"))).alias("fpr"))
    r, f = F.col("recall"), F.col("fpr")
    return p.select("recall", "fpr", F.when(r < 0.98, 0.03).otherwise(0.0).alias("d_semantic"), F.when(r < 0.98, -0.02).otherwise(0.0).alias("d_base"), F.when(f > 0.02, 0.02).otherwise(0.0).alias("d_multimodal"), F.when(f > 0.02, -0.01).otherwise(0.0).alias("d_series"))


@query("agg_gate")
def _gate(spark, sf):
    """Regression gate per run (decoded / undecoded) and overall."""
    m = configs(spark, sf).groupBy("config").agg(ratio(F.count_if((F.col("label") != "Normal") & (F.col("kind") != "plain") & (F.col("p") != "Normal")), F.count_if((F.col("label") != "Normal") & (F.col("kind") != "plain"))).alias("recall"), ratio(F.count_if(~(F.col("label") != "Normal") & (F.col("p") != "Normal")), F.count_if(~(F.col("label") != "Normal"))).alias("fpr"))
    m = m.withColumn("ok", (F.col("recall") >= 0.995) & (F.col("fpr") <= 0.013))
    return m.rollup("config").agg(F.min("recall").alias("recall"), F.max("fpr").alias("fpr"), F.bool_and("ok").alias("ok")).withColumn("config", F.coalesce("config", F.lit("*")))


@query("agg_patch_block_rate")
def _patch(spark, sf):
    from paysieve.plans.label import patch_hits
    return patch_hits(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("cve").isNotNull().cast("double")), 4).alias("block_rate"))


@query("agg_canonical_sync")
def _sync(spark, sf):
    """One summary row from several metric tables."""
    p = predictions(spark, sf)
    a = p.agg(F.count("*").alias("n"), ratio(F.count_if((F.col("label") != "Normal") & (F.col("pred") != "Normal")), F.count_if((F.col("label") != "Normal"))).alias("recall"))
    b = drift(rounds(spark, sf)).select(F.col("mean").alias("round_mean"), F.col("std").alias("round_std"))
    return a.crossJoin(b)


@query("jn_label_eval")
def _je(spark, sf):
    lab, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    return lab.join(docs, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("jn_unseen_kinds")
def _unseen(spark, sf):
    p = payload_rows(spark, sf)
    train = p.filter(F.pmod("row_id", F.lit(64)) < 45).select("kind").distinct()
    return p.filter(F.pmod("row_id", F.lit(64)) >= 45).join(train, "kind", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


# --- top-k -------------------------------------------------------------------------------------
@query("top_weakest")
def _weak(spark, sf):
    p = predictions(spark, sf).filter((F.col("label") != "Normal")).groupBy("kind", "label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred0") != "Normal").cast("double")), 4).alias("recall"))
    return p.orderBy("recall", "kind", "label").limit(8)


@query("top_hardest_first")
def _hard(spark, sf):
    return predictions(spark, sf).filter((F.col("label") != "Normal")).orderBy(F.coalesce("conf", F.lit(1.0)), "row_id").select("row_id", "label", "conf")


@query("top_cap_rows")
def _cap(spark, sf):
    return payload_rows(spark, sf).filter((F.col("label") != "Normal")).orderBy("row_id").limit(80).select("row_id", "payload", "label")


@query("top_samples")
def _samples(spark, sf):
    """First three rows per label: partial top-k per task before the window (WindowGroupLimit)."""
    w = Window.partitionBy("label").orderBy("row_id")
    return payload_rows(spark, sf).select("label", "row_id", "payload", F.row_number().over(w).alias("rn")).filter("rn <= 3").select("label", "row_id", "payload")


@query("top_argmax_label")
def _argmax(spark, sf):
    from paysieve.functions import rules as R
    from paysieve.plans.score import scored
    df = scored(spark, sf, *[f"kw_{k}" for k in R.LABELS])
    arr = F.array(*[F.struct(F.round(f"kw_{k}", 9).alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("label")) for i, k in enumerate(R.LABELS)])
    return df.select("row_id", F.array_max(arr)["label"].alias("argmax"))


# --- sets --------------------------------------------------------------------------------------
def batches(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("payload"), F.lit("documents").alias("source"))
    conv = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("seq"), F.col("text").alias("payload"), F.lit("conversations").alias("source"))
    bench = table(spark, sf, "benchmark").select((F.col("item_id") + 2_000_000_000_000).alias("seq"), F.col("text").alias("payload"), F.lit("benchmark").alias("source"))
    return docs.unionByName(conv).unionByName(bench)


@query("set_union_batches")
def _union(spark, sf):
    return batches(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("chars"))


def dedupe(df):
    """First row per payload hash: the winning seq per hash is a partial aggregate, then a semi join on unique seq."""
    first = df.groupBy(F.sha2("payload", 256).alias("h")).agg(F.min("seq").alias("seq"))
    return df.join(first.select("seq"), "seq", "left_semi")


@query("set_dedupe")
def _dedupe(spark, sf):
    return dedupe(batches(spark, sf)).select("seq", "source", F.length("payload").cast("bigint").alias("n_chars"))


@query("set_variant_distinct")
def _vd(spark, sf):
    p = payload_rows(spark, sf)
    var = p.select("row_id", "payload", F.upper("payload").alias("variant"))
    return var.filter(F.col("variant") != F.col("payload")).groupBy("variant").agg(F.min("row_id").alias("row_id")).join(p.select(F.col("payload").alias("variant")).distinct(), "variant", "left_anti")


@query("set_pool_mix")
def _pool(spark, sf):
    m = misses_raw(spark, sf).select("payload", F.lit(0).alias("prio"), "row_id")
    base = payload_rows(spark, sf).filter((F.col("label") != "Normal")).select("payload", F.lit(1).alias("prio"), "row_id")
    return m.unionByName(base).groupBy("payload").agg(F.min("prio").cast("bigint").alias("prio"), F.min("row_id").alias("row_id"))


def misses_raw(spark, sf):
    return payload_rows(spark, sf).filter((F.col("label") != "Normal") & (infer_label(F.col("payload")) == "Normal"))


@query("set_carry_over")
def _carry(spark, sf):
    """Next pool: all misses plus the first half of the base seeds (cap from a count, order by id)."""
    m = misses_raw(spark, sf).select("row_id", F.lit("miss").alias("origin"))
    base = payload_rows(spark, sf).filter((F.col("label") != "Normal") & (F.col("kind") == "plain")).select("row_id")
    n = base.agg(F.greatest(F.lit(3), F.floor(F.count("*") / 2)).alias("k"))
    cut = position_cut(base, n)
    return m.unionByName(cut.select("row_id", F.lit("carry").alias("origin")))


BLOCKS = 65536


def position_cut(df, n):
    """First k rows by row_id where k is a one-row table.

    Counts per id block (a bounded number of equal id ranges) locate the cut; only that block is ranked.
    """
    b = df.crossJoin(F.broadcast(df.agg((F.max("row_id") + 1).alias("top_")))).withColumn("blk", F.floor(F.col("row_id") * BLOCKS / F.col("top_")))
    per = b.groupBy("blk").agg(F.count("*").alias("c"))
    per = per.withColumn("before_", F.sum("c").over(Window.orderBy("blk")) - F.col("c")).crossJoin(F.broadcast(n))
    j = b.join(F.broadcast(per), "blk").filter(F.col("before_") < F.col("k"))
    rn = F.row_number().over(Window.partitionBy("blk").orderBy("row_id"))
    return j.withColumn("rn", rn).filter(F.col("before_") + F.col("rn") <= F.col("k")).select("row_id")
