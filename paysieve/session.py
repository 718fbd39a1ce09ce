"""Session defaults and checkpoint location."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the jobs rely on.  All of them are runtime SQL settings, so they can be applied to a
# session that the cluster (or a test driver) has already created.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Score rows are wide; beyond this width each projection is compiled (and split into methods)
    # on its own instead of as one whole-stage method that would pass the JVM's 64 KB limit.
    "spark.sql.codegen.maxFields": "40",
    # The JVM never compiles a method above 8,000 bytes; a whole-stage method beyond that would be
    # interpreted for every row, so such stages run projection by projection.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Executors import this package for Arrow functions; it is sent once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="paysieve-pkg-")) / "paysieve.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        sc.addPyFile(str(target))


def configure(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="paysieve-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and gives the next stage a short plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan with fewer splits than cores before CPU-heavy columns; a large scan is left as is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Rows of a narrow table that one task takes through CPU-heavy columns.
ROWS_PER_TASK = 25_000


def spread_rows(df: DataFrame) -> DataFrame:
    """Repartition a narrow scan before CPU-heavy columns, by its number of rows.

    Its splits say little about the work: a split without the middle of a row group is empty, so a file
    of many splits may still hand all its rows to a few tasks.  The count reads the file footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)))


_COLUMNS: dict[tuple[str, str], Column] = {}


def reuse(key: str, build) -> Column:
    """One Column object per application for expressions that are costly to assemble."""
    full = (SparkSession.active().sparkContext.applicationId, key)
    if full not in _COLUMNS:
        _COLUMNS[full] = build()
    return _COLUMNS[full]


def evaluated_once(df: DataFrame, *keep: str, **cols: Column) -> DataFrame:
    """Columns ``keep`` plus costly derived columns that later filters may use.

    A filter on a derived column is moved below its projection by substituting the definition; with
    staged scores that repeats every earlier stage at each reference.  Filters on generator output
    stay above it, so a one-row ``inline`` keeps each definition evaluated once, without a shuffle.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
