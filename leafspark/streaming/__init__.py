"""Containers that arrive in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafspark.sources import palm
from leafspark.sources.files import CONTAINER_GLOB

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_headers(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Headers of containers as they arrive; stateless, so it runs in append mode."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", CONTAINER_GLOB).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return palm.headers(files).drop("content")


def arriving_records(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Records of containers as they arrive."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", CONTAINER_GLOB).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return palm.records(palm.headers(files))
