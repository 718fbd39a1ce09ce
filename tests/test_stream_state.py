"""State that later batches see: inserted memory entries, versions of the rule table; epochs that are run again."""

from paths import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paysieve.plans.label import rule_table
from paysieve.plans.streams import COPIES_FROM
from paysieve.streaming import jobs as J


def test_copies_in_a_later_batch_become_updates(spark):
    rows = {(r.batch, r.action): r for r in entry.queries()["str_feedback_memory"](spark, SF).collect()}
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    copied = e.filter("vec_id % 10 = 3").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids")).first()
    assert rows[1, "update"].n >= copied.n and rows[1, "update"].targets >= copied.ids
    assert (0, "insert") in rows


def test_a_repeated_memory_batch_gives_the_same_plan(spark):
    mem = spark.createDataFrame([(1, [1.0, 0.0], "a")], "vec_id long, embedding array<float>, label string")
    new = spark.createDataFrame([(2, [0.0, 1.0], "b"), (3, [1.0, 0.0], "a")], mem.schema)
    step = J.memory_step(mem, 0.98)
    for _ in range(2):
        plan, after = step(new, 0, None)
        assert {(r.qid, r.action, r.target) for r in plan.collect()} == {(2, "insert", None), (3, "update", 1)}
        assert sorted(r.vec_id for r in after.collect()) == [1, 2]
    plan, after = step(new.withColumn("vec_id", F.col("vec_id") + COPIES_FROM), 1, after)
    assert {(r.action, r.target) for r in plan.collect()} == {("update", 2), ("update", 1)} and after.count() == 2


def test_rows_keep_the_version_of_their_time(spark, tmp_path):
    log = f"{tmp_path}/log"
    base = rule_table(spark)
    base.withColumn("valid_from", F.timestamp_millis(F.lit(0))).write.parquet(f"{log}/version=0")
    batch = spark.createDataFrame([(1, 1_000_000, "union select"), (2, 9_000_000, "union select"), (3, 9_000_000, "<script")], "row_id long, ms long, payload string").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    step = J.rule_step(log)
    assert {(r.row_id, r.version) for r in step(batch, 0, None)[0].collect()} == {(1, 0), (2, 0), (3, 0)}
    base.filter("prio <> 3").withColumn("valid_from", F.timestamp_millis(F.lit(5_000_000))).write.parquet(f"{log}/version=1")
    for _ in range(2):  # the same rows whenever the epoch is run
        assert {(r.row_id, r.version) for r in step(batch, 1, None)[0].collect()} == {(1, 0), (3, 1)}


def test_versions_differ_in_the_query(spark):
    rows = {(r.version, r.cluster): r.n for r in entry.queries()["str_rule_reload"](spark, SF).collect()}
    assert (1, "XSS:added") in rows and (0, "XSS:added") not in rows
    assert (1, "PathTraversal:double") not in rows


def plain_policy(batches, labels, modes, bucket):
    """The automaton as a loop over rows."""
    state = {"canary": dict.fromkeys(labels, J.BASE), "stable": dict.fromkeys(labels, J.BASE), "snapshot": dict.fromkeys(labels, J.BASE)}
    share, ring, events = J.SHARE, [], []
    for k, batch in enumerate(batches):
        frozen = modes[max(m for m in modes if m <= k)] == "freeze"
        learned = observed = 0
        for _seq, src, predicted, true_label, reward in sorted(batch):
            ring = [*ring, reward][-J.RING:]
            observed += not frozen and not share <= bucket(src) < share + 5
            if frozen or bucket(src) >= share:
                continue
            learned += 1
            label, d = (true_label, -J.LR * 0.5) if reward < 0 else (predicted, J.LR * 0.1)
            s = state["stable"][label]
            state["canary"][label] = min(J.HIGHEST, s + J.DRIFT, max(J.LOWEST, s - J.DRIFT, state["canary"][label] + d))
        avg = [sum(ring[-n:]) / len(ring[-n:]) if ring else 0.0 for n in (J.MEAN_OF, J.RING)]
        event = "learn" if learned else "observe"
        if learned and len(ring) >= J.RING and min(avg) >= J.PROMOTE_AT:
            event, share = "promote", min(J.SHARE_MOST, share + J.SHARE_STEP)
            state["snapshot"], state["stable"] = state["stable"], dict(state["canary"])
        elif observed and len(ring) >= J.LEAST_REWARDS and avg[0] <= J.ROLLBACK_AT:
            event = "rollback"
            state["canary"], state["stable"] = dict(state["snapshot"]), dict(state["snapshot"])
        events.append((event, share, {c: {x: round(v, 6) for x, v in t.items()} for c, t in state.items()}))
    return events


def test_the_policy_equals_a_loop(spark):
    from hashlib import md5
    from random import Random
    rng, labels = Random(5), ["SQLi", "XSS", "Normal"]
    bucket = lambda src: int(md5(src.encode()).hexdigest()[:8], 16) % 100

    def feed(first, n, good):
        out = []
        for i in range(first, first + n):
            p, t = rng.choice(labels), rng.choice(labels)
            p = t if rng.random() < good else p
            out.append((i, f"s{rng.randrange(300)}", p, t, 1.0 if p == t else -0.5 if "Normal" not in (p, t) else -1.0))
        return out
    batches = [feed(0, 12, 1.0), feed(12, 300, 0.9), feed(312, 400, 0.95), feed(712, 200, -1), [], feed(912, 60, 0.9), feed(972, 90, 0.9)]
    batches[3] = [r for r in batches[3] if r[4] < 0]
    modes = {0: "canary", 5: "freeze", 6: "canary"}
    want = plain_policy(batches, labels, modes, bucket)
    assert {"promote", "rollback", "observe"} <= {w[0] for w in want}
    step, state = J.automaton_step(labels, modes), None
    for k, (batch, (event, share, thresholds)) in enumerate(zip(batches, want, strict=True)):
        df = spark.createDataFrame(batch, "seq long, src string, predicted string, true_label string, reward double")
        before = state
        for _ in range(2 if k == 3 else 1):  # a batch that is run again gives the same state
            rows, state = step(df, k, before)
        got = rows.collect()
        assert {(r.event, r.share) for r in got} == {(event, share)}
        for c, t in thresholds.items():
            assert {r.label: round(r[c], 6) for r in got} == t, (k, c)


def test_the_review_brings_a_rollback(spark):
    rows = {(r.batch, r.event) for r in entry.queries()["str_policy_automaton"](spark, SF).collect()}
    assert (2, "rollback") in rows and (4, "observe") in rows
