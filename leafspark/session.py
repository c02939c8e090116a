"""Session and table helpers shared by the queries, the tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About so many rows go to a task at most, so that what a task hands to Python at once doesn't grow with the table.
ROWS_OF_A_TASK = 2_500


def local_session(cores: int = 8, app: str = "leafspark", memory: str = "8g") -> SparkSession:
    """A single-JVM session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to two tasks or more for each core, for heavy work on texts.

    A scan's partitions are cut by bytes, but a row group of Parquet is read whole by one of them: a table of few row groups
    has many partitions, most of them without a row. So the number of a scan's partitions tells nothing of the tasks that work.
    Rows are counted first (for a scan, from the footers), and a task gets about ROWS_OF_A_TASK of them at most.
    """
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions(), -(-rows.count() // ROWS_OF_A_TASK))
    # by a hash of the key, so that no later step takes the rows as dealt by the key itself: over a union that has given a key's rows apart
    return rows.repartition(n, F.xxhash64(key))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a temporary folder is set for a session on one machine (tests); on a cluster, whose
    machines don't share one, this is an error.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leafspark-"))
        top = context.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
