"""File sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.session import checkpoint_dir

# Payloads keep their outer white space and line breaks in both directions.
CSV = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
LABELED = "payload STRING, label STRING, source STRING"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/paysieve-{name}-{uuid.uuid4().hex[:12]}"


def read_labeled_csv(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """payload,label[,source] with quoted line breaks; ``first`` caps by the given order of payloads."""
    df = spark.read.schema(LABELED).options(**CSV).csv(path)
    df = df.select(F.coalesce("payload", F.lit("")).alias("payload"), F.coalesce("label", F.lit("Normal")).alias("label"), F.coalesce("source", F.lit("original")).alias("source"))
    return df.orderBy("payload", "label", "source").limit(first) if first else df


def write_labeled_csv(df: DataFrame, path: str, fields: tuple[str, ...] = ("payload", "label", "source")) -> str:
    df.select(*fields).write.options(**CSV).csv(path)
    return path


def read_request_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("method STRING, url STRING, body STRING").options(**CSV).csv(path)
    return df.select(F.coalesce("method", F.lit("GET")).alias("method"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("body", F.lit("")).alias("body"), F.lit("csv").alias("source"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Miss / failure records under either name of the label column; blank lines carry no record."""
    df = spark.read.schema("payload STRING, label STRING, true_label STRING, source STRING, pred STRING, predicted STRING, seq BIGINT").json(path)
    return df.select("seq", F.coalesce("payload", F.lit("")).alias("payload"), F.coalesce("true_label", "label").alias("label"), F.coalesce("predicted", "pred").alias("pred"), "source")


# A body line holds no line break: % and the breaks are escaped, so no body ends its block.
BODY_LINE = "\nX-Escaped-Body: "


def write_blank_line_blocks(requests: DataFrame, path: str) -> None:
    """Every request as one HTTP text block and a blank line; the body is one escaped header line."""
    body = F.replace(F.replace(F.replace("body", F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))
    head = F.concat(F.col("method"), F.lit(" "), F.col("url"), F.lit(" HTTP/1.1\nCookie: "), F.col("cookie"))
    requests.select(F.concat(head, F.when(F.col("body") != "", F.concat(F.lit(BODY_LINE), body)).otherwise(""), F.lit("\n")).alias("value")).write.text(path)


def read_blank_line_blocks(spark: SparkSession, path: str) -> DataFrame:
    """HTTP text blocks separated by blank lines, an escaped body put back behind its blank line; the file name tells attack from normal."""
    df = spark.read.option("lineSep", "\n\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    at = F.instr("value", BODY_LINE)
    body = F.substr("value", at + len(BODY_LINE))
    body = F.replace(F.replace(F.replace(body, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    block = F.when(at > 0, F.concat(F.substr("value", F.lit(1), at - 1), F.lit("\n\n"), body)).otherwise(F.col("value"))
    return df.filter(F.trim("value") != "").select(block.alias("block"), F.when(F.col("file").rlike("(?i)anom"), "anom").otherwise("norm").alias("raw_label"))
