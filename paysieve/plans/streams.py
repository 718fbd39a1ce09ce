"""Streaming queries: each runs its stream over the available input and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.fixtures import payload_rows, table, template_table
from paysieve.functions import rules as R
from paysieve.operators.memory import DUPLICATE
from paysieve.plans.evaluate import feedback, predictions, reward
from paysieve.plans.label import cluster_key, rule_table
from paysieve.plans.memory import vectors
from paysieve.plans.registry import query
from paysieve.operators.metrics import ratio
from paysieve.session import cut_lineage
from paysieve.sources.files import scratch
from paysieve.streaming import jobs as J


def payload_stream(spark, sf):
    tpl = F.broadcast(template_table(spark))
    text = F.replace(F.replace(F.col("tpl"), F.lit("{n}"), F.col("event_id").cast("string")), F.lit("{u}"), F.col("user_id").cast("string"))
    return J.event_stream(spark, sf).join(tpl, F.pmod("event_id", F.lit(64)) == F.col("pid")).select(F.col("event_id").alias("row_id"), "ts", F.col("user_id").cast("string").alias("src"), text.alias("payload"), "label")


def reload_payloads(events):
    tpl = F.broadcast(template_table(events.sparkSession))
    text = F.replace(F.replace(F.col("tpl"), F.lit("{n}"), F.col("event_id").cast("string")), F.lit("{u}"), F.col("user_id").cast("string"))
    return events.join(tpl, F.pmod("event_id", F.lit(64)) == F.col("pid")).select(F.col("event_id").alias("row_id"), "ts", text.alias("payload"))


@query("str_detect")
def _detect(spark, sf):
    return J.alerts(payload_stream(spark, sf)).select("row_id", "pred")


@query("str_source_state")
def _state(spark, sf):
    return J.source_series(J.event_stream(spark, sf)).select("event_id", "user_id", "n_points", F.round("anom", 5).alias("anom"))


@query("str_windowed_stats")
def _win(spark, sf):
    return J.run_to_table(J.windowed_counts(J.event_stream(spark, sf)), "windows").withColumn("win_start", F.col("win_start").cast("timestamp_ntz"))


@query("str_session_bursts")
def _sess(spark, sf):
    s = J.run_to_table(J.session_bursts(J.event_stream(spark, sf)), "bursts")
    return s.select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "n")


@query("str_dedupe")
def _ded(spark, sf):
    return J.run_to_table(J.deduplicated(J.event_stream(spark, sf)), "dedupe").groupBy(F.substring("payload_hash", 1, 1).alias("h")).agg(F.count("*").alias("n"))


@query("str_late_data")
def _late(spark, sf):
    """The later half of the events arrives first; rows behind the watermark are counted, those of closed windows dropped."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    mid = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("mid"))
    j = e.crossJoin(F.broadcast(mid))
    src, out, ckpt, late = (scratch(spark, f"late-{x}") for x in ("in", "out", "ckpt", "rows"))
    # One folder per half, each fed to the end before the next one is there: two triggers in order, whatever the number of files.
    for i, half in enumerate(("ts >= mid", "ts < mid")):
        j.filter(half).drop("mid").write.parquet(f"{src}/{i}")
        stream = spark.readStream.schema(e.schema).parquet(f"{src}/*")
        J.windowed_counts(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
        rows = J.stateful_batches(stream, "late", J.late_step, late)
    return spark.read.parquet(out).agg(F.sum("n").alias("kept")).crossJoin(rows.agg(F.sum("late_rows").alias("late_rows"), F.sum("dropped_rows").alias("dropped_rows")))


@query("str_adaptive_feedback")
def _adapt(spark, sf):
    """Feedback table replayed as a stream; only canary rows learn."""
    path = scratch(spark, "feedback")
    f = feedback(spark, sf).filter("tier='canary'")
    f.select("seq", F.when(F.col("reward") < 0, F.col("true_label")).otherwise(F.col("predicted")).alias("label"), "reward").write.parquet(path)
    s = spark.readStream.schema("seq BIGINT, label STRING, reward DOUBLE").parquet(path)
    return J.adaptive_thresholds(s).groupBy("label").agg(F.max("episodes").alias("episodes"), F.round(F.max_by("threshold", "epoch"), 6).alias("threshold"))


FEEDS, REVIEWED, FROZEN_FROM = 5, 2, 4


def policy_feeds(spark, sf):
    """Feedback in five parts of the ids.  The third comes from a review that only files errors of the undecoded verdict."""
    p = predictions(spark, sf)
    p = p.crossJoin(F.broadcast(payload_rows(spark, sf).agg((F.max("row_id") + 1).alias("end_")))).withColumn("feed", F.floor(F.col("row_id") * FEEDS / F.col("end_")))
    review = F.col("feed") == REVIEWED
    p = p.withColumn("pred", F.when(review, F.col("pred0")).otherwise(F.col("pred"))).filter(~review | (F.col("pred") != F.col("label")))
    return p.select("feed", F.col("row_id").alias("seq"), "src", F.col("pred").alias("predicted"), F.col("label").alias("true_label"), reward().alias("reward"))


@query("str_policy_automaton")
def _automaton(spark, sf):
    """Thresholds and control values after each batch: learning, promotion, rollback to the snapshot, freeze."""
    src, folder = scratch(spark, "policy-feeds"), scratch(spark, "policy-versions")
    feeds = cut_lineage(policy_feeds(spark, sf))
    stream = spark.readStream.schema(feeds.drop("feed").schema).parquet(f"{src}/*")
    step = J.automaton_step(R.LABELS, {0: "canary", FROZEN_FROM: "freeze"})
    for i in range(FEEDS):
        feeds.filter(F.col("feed") == i).drop("feed").write.parquet(f"{src}/{i}")
        rows = J.stateful_batches(stream, "automaton", step, folder)
    return rows.select(F.col("epoch").cast("bigint").alias("batch"), "label", "event", "share", "episodes", "promotions", "rollbacks",
                       *[F.round(c, 6).alias(c) for c in ("avg30", "canary", "stable", "snapshot")])


COPIES_FROM = 1_000_000  # ids of the copies that come back in the second batch


@query("str_feedback_memory")
def _mem(spark, sf):
    """New vectors in two batches; what the first inserts is part of the memory that the second is compared with.

    The second batch brings copies of a part of the first, which become updates.
    """
    src, folder = scratch(spark, "vectors"), scratch(spark, "memory-versions")
    mem, new = vectors(spark, sf)
    cols = ["vec_id", "embedding", "label"]
    first, second = new.filter("vec_id % 10 < 7").select(*cols), new.filter("vec_id % 10 >= 7").select(*cols)
    copies = new.filter("vec_id % 10 = 3").select((F.col("vec_id") + COPIES_FROM).alias("vec_id"), "embedding", "label")
    stream = spark.readStream.schema(first.schema).parquet(f"{src}/*")
    step = J.memory_step(mem.select(*cols), DUPLICATE)
    for i, part in enumerate((first, second.unionByName(copies))):
        part.write.parquet(f"{src}/{i}")
        rows = J.stateful_batches(stream, "memory", step, folder)
    return rows.groupBy(F.col("epoch").cast("bigint").alias("batch"), "action").agg(F.count("*").alias("n"), F.sum("target").alias("targets"))


RELOAD_AT = "2024-01-16 00:00:00"
# User data: what the second version of the rule table adds; it also switches the first rule but one off.
ADDED_RULE = (8, r"onerror(?:=|%3d)", "XSS", 0.51, "XSS:added", True)


def rule_versions(spark):
    """(valid from, rules) of the two versions of the rule table."""
    base = rule_table(spark)
    added = spark.createDataFrame([ADDED_RULE], base.schema)
    return [(None, base), (RELOAD_AT, base.withColumn("enabled", F.col("enabled") & (F.col("prio") != 1)).unionByName(added))]


@query("str_rule_reload")
def _reload(spark, sf):
    """A versioned rule log, extended between two batches; every row is matched with the version valid at its own time."""
    src, folder, log = scratch(spark, "payloads"), scratch(spark, "rule-hits"), scratch(spark, "rule-log")
    events = table(spark, sf, "events").select("event_id", "ts", "user_id")
    stream = reload_payloads(spark.readStream.schema(events.schema).parquet(f"{src}/*"))
    halves = (events.filter(F.col("ts") < F.lit(RELOAD_AT).cast("timestamp")), events.filter(F.col("ts") >= F.lit(RELOAD_AT).cast("timestamp")))
    for i, (part, (start, rules)) in enumerate(zip(halves, rule_versions(spark), strict=True)):
        rules.withColumn("valid_from", F.coalesce(F.lit(start).cast("timestamp"), F.timestamp_millis(F.lit(0)))).write.parquet(f"{log}/version={i}")
        part.write.parquet(f"{src}/{i}")
        rows = J.stateful_batches(stream, "rules", J.rule_step(log), folder)
    return rows.groupBy(F.col("version").cast("bigint").alias("version"), "cluster", "verdict").agg(F.count("*").alias("n"))


@query("str_feedback_cycle")
def _cycle(spark, sf):
    """Evaluate, derive clusters from the misses, apply them, evaluate again; the gate decides on each side."""
    p = predictions(spark, sf)
    miss = p.filter((F.col("label") != "Normal") & (F.col("pred0") == "Normal")).select(cluster_key(F.col("payload"), F.col("label")).alias("c")).distinct()
    learned = p.join(F.broadcast(miss), cluster_key(F.col("payload"), F.col("label")) == F.col("c"), "left")
    after = F.when(F.col("c").isNotNull() & (F.col("label") != "Normal"), F.col("label")).otherwise(F.col("pred0"))
    sides = learned.select("label", "kind", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("pred0").alias("pred")), F.struct(F.lit("after").alias("side"), after.alias("pred")))).alias("x")).select("label", "kind", "x.*")
    m = sides.groupBy("side").agg(ratio(F.count_if((F.col("label") != "Normal") & (F.col("kind") != "plain") & (F.col("pred") != "Normal")), F.count_if((F.col("label") != "Normal") & (F.col("kind") != "plain"))).alias("recall"), ratio(F.count_if(~(F.col("label") != "Normal") & (F.col("pred") != "Normal")), F.count_if(~(F.col("label") != "Normal"))).alias("fpr"))
    return m.withColumn("passed", (F.col("recall") >= 0.995) & (F.col("fpr") <= 0.013))
