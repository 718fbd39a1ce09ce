"""Steps over few rows have as many tasks and jobs as the rows need, whatever the number of shuffle partitions."""

import pytest

from paysieve.llm import near_dup, toxicity

CONF = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_star_steps_do_not_follow_the_shuffle_partitions(spark, many_partitions):
    chains = [(100 * c + i, 100 * c + i + 1) for c in range(5) for i in range(30)]
    links = spark.createDataFrame([*chains, (700, 700), (20, 10)], "a long, b long")
    group = "star-steps"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = near_dup.components(links)
        found = {r["node"]: r["comp"] for r in out.collect()}
        status = spark.sparkContext.statusTracker()
        jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup(group)]
        stages = [status.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        wide = sum(s is not None and s.numTasks >= 40 for s in stages)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {100 * c + i: 100 * c for c in range(5) for i in range(1, 31)}
    assert out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert wide <= 3, sorted(s.numTasks for s in stages if s)[-12:]  # only where the number of links is not known yet


def test_labelled_texts_come_in_few_jobs(spark, docs_frame, many_partitions, monkeypatch):
    docs = docs_frame([(i, f"text {i} of the sample") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    jobs, fitted, iterate = [], [], type(docs).toLocalIterator

    def counted(df, *args, **kwargs):
        jobs.append(df.rdd.getNumPartitions())
        return iterate(df, *args, **kwargs)
    monkeypatch.setattr(type(docs), "toLocalIterator", counted)
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: fitted.extend(zip(texts, toxic, strict=True)))
    toxicity.train(docs, labels, limit=500)
    own = sorted(r["doc_id"] for r in labels.where(~toxicity.held_out(labels["doc_id"])).collect())
    assert fitted == [(f"text {i} of the sample", i % 2) for i in own]
    assert jobs == [2]
