"""Structured Streaming twin of the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paysieve.operators import windows as W
from paysieve.operators.scale import clamp_fold
from paysieve.plans.normalise import normalised
from paysieve.session import cut_lineage, evaluated_once, spread_rows
from paysieve.sources.files import scratch


def event_stream(spark: SparkSession, sf: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as a file stream with event time."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the available input to the end into a parquet table; exactly-once by checkpoint and file sink."""
    spark = df.sparkSession
    out, ckpt = scratch(spark, name), scratch(spark, f"{name}-ckpt")
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_batches(df: DataFrame, name: str, handle, ckpt: str | None = None) -> None:
    ckpt = ckpt or scratch(df.sparkSession, f"{name}-ckpt")
    df.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()


def alerts(payloads: DataFrame) -> DataFrame:
    """Detection by the fused verdict of the whole cascade, batch by batch; an epoch that is run again replaces its rows."""
    from paysieve.plans.decide import gated_verdicts

    out = scratch(payloads.sparkSession, "alerts")

    def handle(batch: DataFrame, epoch: int) -> None:
        # The files of a batch may have few row groups, which would be as many tasks.
        rows = normalised(spread_rows(batch)).withColumns({"raw": F.col("payload"), "location": F.lit("query")})
        found = gated_verdicts(rows, "row_id", "ts", "src", "location")
        found = evaluated_once(found, "row_id", "ts", "src", pred=F.col("pred"), conf=F.col("conf"), mal=F.col("mal"))
        found.filter("mal").drop("mal").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    run_batches(payloads, "alerts", handle)
    return payloads.sparkSession.read.parquet(out)


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value")) \
        .select(F.col("window.start").alias("win_start"), "event_type", "n", "mean_value")


def session_bursts(events: DataFrame, watermark: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Session windows merge map-side and in state by (source, session), never as raw rows of a source."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")) \
        .select("user_id", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


def deduplicated(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    h = F.substring(F.sha2(F.concat_ws("|", "event_type", "props"), 256), 1, 16)
    return events.withColumn("payload_hash", h).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["payload_hash"]).select("event_id", "ts", "payload_hash")


def stateful_batches(df: DataFrame, name: str, step, folder: str | None = None) -> DataFrame:
    """Runs ``step(batch, epoch, state) -> (rows, next state)`` over all micro-batches; the first state is None.

    Rows and state are tables with one folder per epoch; an epoch that is run again replaces its own.  A stream
    that is started again with the same ``folder`` goes on where it ended.
    """
    folder = folder or scratch(df.sparkSession, name)
    out, kept = f"{folder}/rows", f"{folder}/state"

    def handle(batch: DataFrame, epoch: int) -> None:
        state = batch.sparkSession.read.parquet(f"{kept}/{epoch - 1}") if epoch else None
        rows, after = step(batch, epoch, state)
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        after.write.mode("overwrite").parquet(f"{kept}/{epoch}")
    run_batches(df, name, handle, f"{folder}/ckpt")
    return df.sparkSession.read.parquet(out)


def late_step(batch: DataFrame, epoch: int, state: DataFrame | None, delay_ms: int = 600_000, width: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Input rows of a batch behind the watermark (latest time of all earlier batches less the delay, in milliseconds),
    and those among them whose window has closed, which ``windowed_counts`` drops."""
    newest = batch.agg(F.max("ts").alias("newest"))
    if state is None:
        return batch.agg(F.lit(0).cast("bigint").alias("late_rows"), F.lit(0).cast("bigint").alias("dropped_rows")), newest
    mark = F.timestamp_millis(F.unix_millis("newest") - delay_ms)
    rows = batch.select("ts", F.window("ts", width)["end"].alias("end_ts")).crossJoin(F.broadcast(state.select(mark.alias("mark"))))
    counts = rows.agg(F.count_if(F.col("ts") < F.col("mark")).alias("late_rows"), F.count_if(F.col("end_ts") <= F.col("mark")).alias("dropped_rows"))
    return counts, state.unionByName(newest).agg(F.max("newest").alias("newest"))


def series_step(batch: DataFrame, epoch: int, state: DataFrame | None, rows: int = W.CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rate and entropy series of the last sixteen points per source -> anomaly score per event.

    A source's points of one batch are split into time chunks with a halo; its last sixteen points are the
    state and stand before the whole next batch, so no source is gathered in one task.
    """
    cols = ["user_id", "epoch_", "ts", "event_id", "entropy"]
    now = W.time_chunks(batch.withColumn("epoch_", F.lit(epoch).cast("bigint")).select(*cols), "ts", rows)
    if state is not None:
        now = state.select(*cols, F.lit(-1).cast("bigint").alias("tc_")).unionByName(now)
    order = ["epoch_", "ts", "event_id"]
    scored = W.series_encoding(W.source_matrix(now, "user_id", order, ["entropy"])).filter(F.col("epoch_") == epoch)
    last = now
    for key in (["user_id", "tc_"], ["user_id"]):
        w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
        last = last.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= W.SERIES)
    return scored.select("event_id", "user_id", "n_points", "anom"), last.select(*cols)


def source_series(events: DataFrame) -> DataFrame:
    from paysieve.functions.features import entropy
    e = events.select("event_id", "user_id", "ts", entropy(F.concat_ws("|", "event_type", "props")).alias("entropy"))
    return stateful_batches(e, "series", series_step)


def memory_step(initial: DataFrame, threshold: float):
    """Inserts and updates of a batch against the memory so far; the memory with the batch's inserts is the next state.

    The plan of a batch is written once, so its rows and the next state come from the same comparison.
    """
    from paysieve.operators.memory import upsert_plan

    def step(batch: DataFrame, epoch: int, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        memory = initial if state is None else state
        plan = cut_lineage(upsert_plan(batch, memory, "vec_id", "embedding", "vec_id", "label", threshold))
        fresh = plan.filter("action = 'insert'").select(F.col("qid").alias("vec_id"))
        return plan, memory.unionByName(batch.join(fresh, "vec_id", "left_semi").select(*memory.columns))
    return step


def rule_step(log: str):
    """Hits of a batch by the rule versions in a log (folders ``version=n``, read again for every batch).

    A row is matched with the last version whose ``valid_from`` is not after the row's time, so an epoch that is run again
    after the log has grown gives the same rows.
    """
    from paysieve.plans.label import match_rules

    def step(batch: DataFrame, epoch: int, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rules = batch.sparkSession.read.parquet(log)
        versions = [(r.version, r.valid_from) for r in rules.groupBy("version").agg(F.min("valid_from").alias("valid_from")).orderBy("valid_from").collect()]  # rows of a log
        out = None
        for (version, start), end in zip(versions, [*[v for _, v in versions[1:]], None], strict=True):
            own = batch.filter(F.col("ts") >= F.lit(start))
            own = own if end is None else own.filter(F.col("ts") < F.lit(end))
            t = own.select("row_id", F.col("payload").alias("raw"), F.lower("payload").alias("low"), F.lit(False).alias("form"))
            hits = match_rules(t, rules.filter(F.col("version") == version).drop("version", "valid_from")).filter("rule_ is not null")
            hits = hits.select("row_id", F.lit(version).alias("version"), F.col("rule_.label").alias("verdict"), F.col("rule_.cluster").alias("cluster"))
            out = hits if out is None else out.unionByName(hits)
        return out, rules.groupBy("version").agg(F.count("*").alias("rules"))
    return step


BASE, DRIFT, LR = 0.38, 0.08, 0.05


def policy_step(batch: DataFrame, epoch: int, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Canary learning per class: step on each reward, at most DRIFT away from the stable threshold.

    Rows hold the threshold of a class after the batch and its episodes so far.  The steps compose, so they are
    folded in chunks; the threshold so far is the first step of its class.
    """
    step = F.when(F.col("reward") < 0, -LR * 0.5).otherwise(LR * 0.1)
    steps = batch.select("label", "seq", step.alias("d"))
    n = batch.groupBy("label").agg(F.count("*").alias("n_"))
    if state is not None:
        first = batch.agg((F.min("seq") - 1).alias("seq"))
        steps = state.crossJoin(F.broadcast(first)).select("label", "seq", (F.col("threshold") - BASE).alias("d")).unionByName(steps)
        n = state.select("label", F.col("episodes").alias("n_")).unionByName(n).groupBy("label").agg(F.sum("n_").alias("n_"))
    fold = clamp_fold(steps, "label", "seq", F.col("d"), BASE - DRIFT, BASE + DRIFT, F.lit(BASE))
    after = fold.join(n, "label").select("label", F.col("value").alias("threshold"), F.col("n_").alias("episodes"))
    return after, after


def adaptive_thresholds(feedback: DataFrame) -> DataFrame:
    """Threshold and episodes per class after each batch (column ``epoch``)."""
    return stateful_batches(feedback, "policy", policy_step)


# Fixed values of the policy: bounds of a threshold, rewards that are kept and averaged, levels, canary share.
LOWEST, HIGHEST = 0.2, 0.95
RING, MEAN_OF, LEAST_REWARDS = 40, 30, 15
ROLLBACK_AT, PROMOTE_AT = -0.25, 0.15
SHARE, SHARE_STEP, SHARE_MOST = 10, 5, 50


def first_policy(spark: SparkSession, labels: list[str]) -> DataFrame:
    """One row per class: thresholds of the canary, the stable policy and the snapshot, and the control values of all classes."""
    zero = F.lit(0).cast("bigint")
    base = {c: F.lit(BASE) for c in ("canary", "stable", "snapshot")}
    return spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label")).withColumns(
        {**base, "share": F.lit(SHARE).cast("bigint"), "episodes": zero, "promotions": zero, "rollbacks": zero, "ring": F.array().cast("array<double>")})


def automaton_step(labels: list[str], modes: dict[int, str]):
    """Policy automaton over batches of (seq, src, predicted, true_label, reward); ``modes``: first batch -> canary or freeze.

    In a batch the sources of the canary share learn, at most DRIFT away from the stable threshold; the next ones (shadow)
    and all of a frozen batch are only observed.  At its end the mean of the last rewards decides: from PROMOTE_AT on (last
    30 and last 40) the stable policy becomes the snapshot, the canary the stable policy, and the share grows; down to
    ROLLBACK_AT both return to the snapshot.  An empty batch changes nothing; rewards of equal ``seq`` are ordered by value;
    classes outside ``labels`` have no threshold.  The state is a row per class with at most RING rewards, so a batch that
    is run again from the state before it gives the same transition.
    """
    from paysieve.plans.evaluate import source_bucket

    def mean(ring, n: int):
        part = F.slice(ring, F.greatest(F.size(ring) - (n - 1), F.lit(1)), n)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(part), F.lit(1))

    def step(batch: DataFrame, epoch: int, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        mode = modes[max(k for k in modes if k <= epoch)]
        state = first_policy(batch.sparkSession, labels) if state is None else state.select(*first_policy(batch.sparkSession, labels).columns)
        now = state.agg(F.max("share").alias("share_"))
        rows = batch.crossJoin(F.broadcast(now)).withColumn("bucket_", source_bucket(F.col("src")))
        canary = F.lit(mode != "freeze") & (F.col("bucket_") < F.col("share_"))
        observed = F.lit(mode != "freeze") & ~F.col("bucket_").between(F.col("share_"), F.col("share_") + 4)
        counts = rows.agg(F.count("*").alias("n_"), F.count_if(canary).alias("learned_"), F.count_if(observed).alias("observed_"), F.coalesce(F.min("seq") - 1, F.lit(0)).alias("before_"))
        last = batch.orderBy(F.desc("seq"), F.desc("reward")).limit(RING).agg(F.array_sort(F.collect_list(F.struct("seq", "reward"))).alias("last_"))
        known = state.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(last))

        steps = rows.filter(canary).select(F.when(F.col("reward") < 0, F.col("true_label")).otherwise(F.col("predicted")).alias("label"), "seq",
                                           F.when(F.col("reward") < 0, -LR * 0.5).otherwise(LR * 0.1).alias("d"))
        start = known.select("label", F.col("before_").alias("seq"), (F.col("canary") - BASE).alias("d"))
        bounds = state.select("label", F.greatest(F.lit(LOWEST), F.col("stable") - DRIFT).alias("lo"), F.least(F.lit(HIGHEST), F.col("stable") + DRIFT).alias("hi"))
        fold = clamp_fold(start.unionByName(steps).join(F.broadcast(bounds), "label"), "label", "seq", F.col("d"), F.col("lo"), F.col("hi"), F.lit(BASE))

        rewards = F.concat("ring", F.transform("last_", lambda x: x["reward"]))
        known = known.join(F.broadcast(fold), "label").withColumn("ring", F.slice(rewards, F.greatest(F.size(rewards) - (RING - 1), F.lit(1)), RING))
        known = known.withColumn("avg30", mean(F.col("ring"), MEAN_OF))
        promote = (F.col("learned_") > 0) & (F.size("ring") >= RING) & (F.col("avg30") >= PROMOTE_AT) & (mean(F.col("ring"), RING) >= PROMOTE_AT)
        rollback = (F.col("observed_") > 0) & (F.size("ring") >= LEAST_REWARDS) & (F.col("avg30") <= ROLLBACK_AT)
        known = known.withColumn("event", F.when(promote, "promote").when(rollback, "rollback").when(F.col("learned_") > 0, "learn").otherwise("observe"))
        is_ = F.col("event").eqNullSafe
        after = cut_lineage(known.select(
            "label", F.when(is_("rollback"), F.col("snapshot")).otherwise(F.col("value")).alias("canary"),
            F.when(is_("promote"), F.col("value")).when(is_("rollback"), F.col("snapshot")).otherwise(F.col("stable")).alias("stable"),
            F.when(is_("promote"), F.col("stable")).otherwise(F.col("snapshot")).alias("snapshot"),
            F.when(is_("promote"), F.least(F.col("share") + SHARE_STEP, F.greatest(F.col("share"), F.lit(SHARE_MOST)))).otherwise(F.col("share")).cast("bigint").alias("share"),
            (F.col("episodes") + F.col("n_")).alias("episodes"), (F.col("promotions") + is_("promote").cast("bigint")).alias("promotions"),
            (F.col("rollbacks") + is_("rollback").cast("bigint")).alias("rollbacks"), "ring", "avg30", "event"))
        return after.drop("ring"), after
    return step
