"""Intermediate tables of the operators, in the folder that all executors share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from leafspark.session import shared_folder

#: Folders handed out inside of the innermost ``released`` of this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("leafspark_scope", default=None)
_BATCH_OPTIONS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the folder that all executors share; what is taken inside of ``released`` is deleted at its end."""
    at = shared_folder(spark, name)
    taken = _SCOPE.get()
    if taken is not None:
        taken.append(at)
    return at


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all folders that operators took inside, in this thread; their results must have been written by then."""
    taken: list[str] = []
    before = _SCOPE.set(taken)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for folder in taken:
            remove(spark, folder)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 2_000, size: int = 16_000_000) -> Iterator[None]:
    """Hold the batches that tasks exchange with Python to so many rows and about so many bytes, unless they are smaller already.

    Texts are larger than most rows; the defaults would hold tens of megabytes several times in each
    task. The session's options are as before when this ends, so only what is written inside is bounded.
    """
    before = {key: spark.conf.get(key) for key in _BATCH_OPTIONS}
    for key, most in zip(_BATCH_OPTIONS, (rows, size), strict=True):
        now = re.fullmatch(r"(\d+)b?", before[key])
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Scratch:
    """Tables written one by one: lineage is cut, and any executor can read them. Those no longer needed are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = shared_dir(self.spark, name)
        with bounded_batches(self.spark):
            df.write.parquet(at)
        self.folders[name] = at
        return self.spark.read.parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.folders.pop(name))

    def keep_only(self, *names: str) -> None:
        self.drop(*[n for n in self.folders if n not in names])


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    return Scratch(df.sparkSession).save(df, name)
