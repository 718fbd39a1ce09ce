"""Window and policy queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from paysieve.fixtures import local_table, payload_rows, table
from paysieve.functions import features as X
from paysieve.functions import rules as R
from paysieve.operators import windows as W
from paysieve.operators.scale import clamp_fold
from paysieve.plans.evaluate import feedback, traffic_tier
from paysieve.plans.label import inferred_templates
from paysieve.plans.registry import query
from paysieve.session import spread


# The usual level is -.25; the sample feedback never falls that low, so the query uses a higher level.
ROLLBACK_AT = 0.8


def event_points(spark, sf):
    e = spread(table(spark, sf, "events"))
    t = F.concat_ws("|", "event_type", "props")
    return W.time_chunks(e.select("event_id", "ts", "user_id", X.entropy(t).alias("entropy"), (F.regexp_count(t, F.lit(r"[^\p{L}\p{N}]")) / F.length(t)).alias("special"),
                                  (X.count_char(t, "%") / F.length(t)).alias("encoded"), F.length(t).cast("double").alias("len"), F.lit(0.0).alias("depth")), "ts")


def matrices(spark, sf):
    return W.source_matrix(event_points(spark, sf), "user_id", ["ts", "event_id"], ["entropy", "special", "encoded", "len", "depth"])


@query("fea_qps_slot")
def _qps(spark, sf):
    e = W.time_chunks(table(spark, sf, "events").select("event_id", "ts", "user_id"), "ts")
    rows, w = W.chunked(e, ["user_id"], ["ts", "event_id"], 1)
    return W.own_rows(rows.withColumn("qps", W.request_rate(w))).select("event_id", "user_id", F.round("qps", 8).alias("qps"))


@query("win_source_buffer")
def _buf(spark, sf):
    m = matrices(spark, sf)
    return m.select("event_id", "user_id", "n_points", *[F.round(F.aggregate("matrix", F.lit(0.0), add_at(i)), 4).alias(f"sum{i}") for i in range(1, 5)], F.round(F.element_at("matrix", 1)[4], 4).alias("oldest_len"))


def add_at(i):
    return lambda a, p: a + p[i]


@query("win_moving_average")
def _ma(spark, sf):
    s = W.series_encoding(matrices(spark, sf))
    return s.select("event_id", *[F.round(F.col("trend")[i], 5).alias(f"t{i}") for i in (0, 1, 7, 14, 15)])


@query("win_trend_residual")
def _tr(spark, sf):
    s = W.series_encoding(matrices(spark, sf))
    return s.select("event_id", *[F.round(c, 5).alias(c) for c in ("resid", "slope", "qps_mean")])


@query("sco_dlinear")
def _dl(spark, sf):
    return W.series_encoding(matrices(spark, sf)).select("event_id", F.round("anom", 5).alias("anom"))


def rolling_reward(spark, sf):
    """Feedback with mean and count of the last 30 / 40 rewards in seq order (chunked, 39 rows of halo)."""
    f = W.id_chunks(feedback(spark, sf).select("seq", "tier", "predicted", "true_label", "reward"), "seq")
    rows, w = W.chunked(f, [], ["seq"], 39)
    rows = rows.withColumns({"avg30": F.avg("reward").over(w.rowsBetween(-29, 0)), "avg40": F.avg("reward").over(w.rowsBetween(-39, 0)), "n40": F.count("*").over(w.rowsBetween(-39, 0))})
    return W.own_rows(rows)


@query("win_reward_avg")
def _wr(spark, sf):
    return rolling_reward(spark, sf).select("seq", F.round("avg30", 6).alias("avg30"))


@query("str_rollback")
def _rb(spark, sf):
    r = rolling_reward(spark, sf).filter((F.col("n40") >= 15) & (F.round("avg30", 6) <= ROLLBACK_AT))
    return r.select("seq", F.round("avg30", 6).alias("avg30"))


@query("str_promote")
def _pm(spark, sf):
    r = rolling_reward(spark, sf).filter((F.col("tier") == "canary") & (F.col("n40") >= 40) & (F.round("avg30", 6) >= 0.15) & (F.round("avg40", 6) >= 0.15))
    return r.groupBy(F.floor(F.col("seq") / 1000).alias("block")).agg(F.count("*").alias("eligible"), F.min("seq").alias("first_seq"))


@query("win_reward_history")
def _rh(spark, sf):
    last = feedback(spark, sf).orderBy(F.desc("seq")).limit(100)
    return last.select("seq", F.row_number().over(Window.orderBy("seq")).cast("bigint").alias("episode"), "reward")


@query("win_lru_evict")
def _lru(spark, sf):
    m = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 7).alias("hits"))
    return m.orderBy(F.desc("hits"), F.desc("vec_id")).limit(100)


@query("win_round_robin")
def _rrb(spark, sf):
    d = table(spark, sf, "documents").select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("rn")).filter("rn <= 50")
    return d.orderBy("rn", "lang").limit(50).select("lang", "doc_id")


# User data: templates that are already registered.
KNOWN_TEMPLATES = ["insert_null_byte", "hex_wrap_keywords"]


@query("win_technique_counter")
def _tc(spark, sf):
    p = payload_rows(spark, sf).filter("label<>'Normal'").select("row_id", F.explode(inferred_templates(F.col("payload"))).alias("template"))
    first = p.groupBy("template").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n")).filter(~F.col("template").isin(KNOWN_TEMPLATES))
    return first.select("template", "row_id", "n", F.row_number().over(Window.orderBy("row_id", "template")).cast("bigint").alias("num"))


@query("win_session_gap")
def _sess(spark, sf):
    e = W.time_chunks(table(spark, sf, "events").select("event_id", "ts", "user_id"), "ts")
    return W.sessions(e, "user_id", ["ts", "event_id"], 6 * 3600).select("user_id", F.col("burst").cast("bigint").alias("burst"), "n", "start_ts", "end_ts")


@query("ml_online_threshold")
def _thr(spark, sf):
    f = feedback(spark, sf)
    step = f.select("seq", F.when(F.col("reward") < 0, F.col("true_label")).otherwise(F.col("predicted")).alias("label"), F.when(F.col("reward") < 0, -0.025).otherwise(0.005).alias("d"))
    return clamp_fold(step, "label", "seq", F.col("d"), 0.2, 0.95, F.lit(0.38)).select("label", F.round("value", 6).alias("threshold"))


@query("fea_weight_update")
def _fw(spark, sf):
    f = feedback(spark, sf).select("seq", F.concat_ws("_", F.lit("f"), F.pmod("seq", F.lit(15)).cast("string")).alias("feature"), (F.col("reward") * 0.05).alias("d"))
    return clamp_fold(f, "feature", "seq", F.col("d"), 0.01, 2.0, F.lit(0.5)).select("feature", F.round("value", 6).alias("weight"))


# --- tiers and policy --------------------------------------------------------------------------
# User data: thresholds per tier and label.
POLICY = [(t, k, round(base + 0.01 * i, 2)) for t, base in (("canary", 0.36), ("shadow", 0.38), ("stable", 0.38)) for i, k in enumerate(R.LABELS)]


@query("str_traffic_tier")
def _tier(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", traffic_tier(F.col("user_id").cast("string")).alias("tier"))


@query("jn_policy_thresholds")
def _jp(spark, sf):
    pol = F.broadcast(local_table(spark, POLICY, [("tier", pa.string()), ("predicted", pa.string()), ("threshold", pa.float64())]))
    return feedback(spark, sf).join(pol, ["tier", "predicted"]).select("seq", "tier", "predicted", "threshold")


def policy_history(spark, sf):
    """Policy in force from each day on: threshold from the share of error events of that day, per tier."""
    e = table(spark, sf, "events").withColumn("tier", traffic_tier(F.col("user_id").cast("string")))
    d = e.groupBy("tier", F.date_trunc("day", "ts").alias("day")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("err"))
    return d.select("tier", (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("valid_from"), F.round(0.38 - 0.1 * F.col("err"), 6).alias("threshold"))


@query("jn_policy_asof")
def _asof(spark, sf):
    """As-of join: the history (days x tiers) is one sorted array per tier, searched inside the row."""
    hist = policy_history(spark, sf).groupBy("tier").agg(F.array_sort(F.collect_list(F.struct("valid_from", "threshold"))).alias("h_"))
    e = table(spark, sf, "events").select("event_id", "ts", traffic_tier(F.col("user_id").cast("string")).alias("tier"))
    at = F.array_max(F.filter("h_", lambda h: h["valid_from"] <= F.col("ts")))
    return e.join(F.broadcast(hist), "tier", "left").select("event_id", "tier", at["threshold"].alias("threshold"))


@query("str_freeze")
def _freeze(spark, sf):
    """Under freeze every request is served by the stable tier and only observed."""
    f = feedback(spark, sf).crossJoin(F.broadcast(spark.range(1).select(F.lit("freeze").alias("mode"))))
    served = F.when(F.col("mode") == "freeze", "stable").otherwise(F.col("tier"))
    applied = (F.col("mode") != "freeze") & (F.col("tier") == "canary")
    return f.groupBy("tier", served.alias("served")).agg(F.count("*").alias("observed"), F.count_if(applied).alias("applied"))


@query("str_policy_audit")
def _audit(spark, sf):
    f = feedback(spark, sf)
    return f.groupBy("tier").agg(F.count("*").alias("episodes"), F.max("seq").alias("last_seq"), F.max_by("predicted", "seq").alias("last_predicted"), F.max_by("true_label", "seq").alias("last_label"), F.round(F.avg("reward"), 4).alias("avg_reward"))
