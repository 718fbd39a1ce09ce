"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.session import checkpoint_dir, cut_lineage, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters, digits and everything beyond ASCII are word characters; all other characters separate words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and bound the Arrow batches, so that very long texts do not meet in one batch."""
    ship_package(spark)
    for key, value in {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint in the shared folder: computed once, read again after a lost executor."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession) -> str:
    return checkpoint_dir(spark).rstrip("/")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_array(c: Column) -> Column:
    """Lower-cased words of a text; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(c, F.lit(""))), NOT_WORD, -1), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart by id and text: repeated rows share it, other texts under the same id do not."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.length(text).cast("string"))
