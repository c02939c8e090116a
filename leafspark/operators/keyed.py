"""Small tables with a unique name."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Limits of a themes table.
MOST_THEMES, MOST_NAME = 4096, 31


def lookup(rows: DataFrame, table: DataFrame, name: str, keyed: str) -> DataFrame:
    """``rows`` joined to the row of ``table`` whose name is equal but for case; rows without one have nulls."""
    return rows.join(table, F.lower(F.col(name)) == F.lower(F.col(keyed)), "left")


def insertion_points(rows: DataFrame, table: DataFrame, name: str, keyed: str) -> DataFrame:
    """Number of the table's names that are less than each row's, case aside: where the row would be put.

    The table holds a few thousand names at most (MOST_THEMES), which is checked; it goes to every task as
    one sorted list and is searched by halving (names compare by their UTF-8 bytes, as in Spark).
    """
    names = sorted(x[0].encode() for x in table.select(F.lower(keyed)).where(F.col(keyed).isNotNull()).limit(MOST_THEMES + 1).collect())
    if len(names) > MOST_THEMES:
        raise ValueError(f"a keyed table holds {MOST_THEMES} names at most")
    held = table.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else bisect_left(held.value, x.encode())).astype("Int64")

    return rows.withColumn("insertion_point", place(F.lower(F.col(name))))


def insert_absent(table: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` that may be added: a name of 1 to 31 characters that the table lacks (case aside); of equal names the first."""
    fits = rows.where(F.length(name).between(1, MOST_NAME))
    new = fits.withColumn("_n", F.lower(name)).join(table.select(F.lower(name).alias("_n")).distinct(), "_n", "left_anti")
    first = Window.partitionBy("_n").orderBy(*[c for c in rows.columns])
    return new.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*rows.columns)


def theme_bytes(themes: DataFrame, name: str, colours: str) -> DataFrame:
    """Stored size of each theme: 4, two for each character of its name and four for each colour."""
    return themes.withColumn("size", (4 + 2 * F.length(name) + 4 * F.col(colours)).cast("long"))


def table_bytes(themes: DataFrame, keys: list[str], name: str, colours: str) -> DataFrame:
    """Stored size of each table of themes: the sum of its themes'."""
    return theme_bytes(themes, name, colours).groupBy(*keys).agg(F.sum("size").alias("size"))
