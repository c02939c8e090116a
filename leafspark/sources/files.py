"""Files and listings as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTAINER_GLOB = "*.[pP][dD][bB]"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def read_files(spark: SparkSession, folders: list[str], glob: str = CONTAINER_GLOB) -> DataFrame:
    """path, name, length, modified and content of the files of each folder, one level deep; folders aren't deduplicated.

    ``content`` is only read where it is selected, and filters on length and modified reach the scan.
    """
    each = [
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f)
        .select("path", file_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")
        for f in folders
    ]
    return reduce(DataFrame.unionAll, each)


def list_containers(names: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name ends in .pdb in any case."""
    return names.where(F.lower(name).endswith(".pdb"))


def in_name_order(files: DataFrame, name: str = "name", then: str = "path") -> DataFrame:
    """Rows in order of name without regard to case, then of ``then``, with their position; ranked in one sorted pass."""
    return files.orderBy(F.lower(name), name, then)


def with_rank(files: DataFrame, keys: list[str], name: str = "name", then: str = "path") -> DataFrame:
    """Position of each row among those of its ``keys``, in name order; a key's rows are spread over many tasks."""
    from leafspark.operators.prefix import in_two_levels

    placed = in_two_levels(files, keys, [F.lower(F.col(name)), F.col(name), F.col(then)], position="position")
    return placed.withColumn("position", F.col("position").cast("int"))


def diagnostics(rows: DataFrame, stage: str, code: Column, message: Column, path: str = "path") -> DataFrame:
    """A row for each failure: path, stage, code (below 0) and message."""
    return rows.select(path, F.lit(stage).alias("stage"), code.cast("int").alias("code"), message.alias("message")).where(F.col("code") < 0)
