"""Pipeline stages: documents in, documents out, each by one operator; the last one gives packed sequences.

A stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame.  Filters find the rows to drop
and remove them with an anti join on their keys, which is broadcast only while small; texts are not shuffled then.

Defined cases: rows with null text or doc_id pass the filters; where rows repeat a doc_id, near_dedup keeps the one with
the least text;
columns other than those of documents are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.llm import decontaminate, near_dup, secrets, tokens, toxicity
from paysieve.llm.common import prepare, row_key, saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose score reaches their language's threshold."""
    labels = table(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels)
    marked = docs.join(decontaminate.bounded(saved(labels.where("doc_id IS NOT NULL").select("doc_id").distinct())), "doc_id", "left_semi")
    scored = toxicity.score(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), net, "doc_id", "lang")
    cut = toxicity.threshold_column(toxicity.language_thresholds(scored, labels), F.col("lang"))
    return toxicity.score(docs, net, *COLUMNS).where(F.col("score") < cut).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    prepare(spark)
    docs = docs.select(COLUMNS)
    groups = saved(near_dup.groups(docs))
    dropped = decontaminate.bounded(saved(groups.where("NOT kept").select("doc_id").distinct()))
    kept = docs.join(dropped, "doc_id", "left_anti").select(COLUMNS)
    repeated = saved(groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(one).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of whose words a twentieth or more stand in spans of benchmark items."""
    found = decontaminate.judge(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    keys = decontaminate.bounded(saved(found.select(F.col("key").alias("_key")).distinct()))
    return docs.join(keys, row_key(docs["doc_id"], docs["text"]) == keys["_key"], "left_anti").select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace found secrets in the texts; n_chars follows where a text changed."""
    prepare(spark)
    rows = secrets.scan(docs, *COLUMNS)
    text = secrets.masked(F.col("text"), F.col("spans"))
    clean = rows.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
    return clean.select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of power-of-two lengths."""
    prepare(spark)
    return tokens.pack(docs, tokens.tokenizer_path(), end_id=0)
