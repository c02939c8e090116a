"""Running sums, positions and next values within keys, in two levels, so that one key's rows are spread over many tasks.

Keys are cut into ranges of their order at limits that a bounded sample gives. A range's totals are
aggregated before the shuffle, a window over the few ranges of each key adds up what stands before them, and
a window inside of each range does the rest. Limits decide where rows are worked on, never what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLED = 10_000


def limits(rows: DataFrame, order: list[Column], parts: int) -> list[tuple]:
    """At most ``parts`` - 1 places of the order, in order, that cut a sample of about SAMPLED rows evenly."""
    asked = rows.select(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    n = asked.count()
    if n < 2 or parts < 2:
        return []
    sample = asked if n <= SAMPLED else asked.sample(min(1.0, 0.9 * SAMPLED / n), seed=1)
    held = sample.sort(*asked.columns).limit(2 * SAMPLED).collect()
    found = [tuple(held[len(held) * k // parts]) for k in range(1, parts) if held]
    return [x for i, x in enumerate(found) if all(v is not None for v in x) and (i == 0 or x != found[i - 1])]


def range_of(rows: DataFrame, order: list[Column], places: list[tuple]) -> Column:
    """Number of the range that a row lies in, by halving the list of limits; a row without an order lies in the first."""
    own = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    kinds = rows.select(own.alias("x")).schema["x"].dataType

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        limit = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(places[middle], kinds, strict=True)])
        return F.when(own < limit, below(low, middle)).otherwise(below(middle + 1, high))

    return F.when(order[0].isNull(), 0).otherwise(below(0, len(places)))


def in_two_levels(rows: DataFrame, keys: list[str], order: list[Column], before: dict[str, Column] | None = None, following: dict[str, Column] | None = None, position: str | None = None, parts: int = 64) -> DataFrame:
    """``rows`` with, by ``order`` within ``keys``: sums of the rows ``before``, the value of the row ``following`` (null for the last), and its ``position`` from 0.

    The order must tell rows of a key apart, or their results are told apart at random. Null values add nothing.
    """
    before, following = before or {}, following or {}
    placed = rows.withColumn("_range", range_of(rows, order, limits(rows, order, parts)))
    tuple_of = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    totals = placed.groupBy(*keys, "_range").agg(
        F.count("*").alias("_n"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{n}") for n, c in before.items()],
        *[F.min_by(F.struct(c.alias("v")), tuple_of).alias(f"_f_{n}") for n, c in following.items()],
    )
    by_range = Window.partitionBy(*keys).orderBy("_range")
    above = by_range.rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_n": "_n"} | {f"_t_{n}": f"_t_{n}" for n in before}
    bases = totals.select(*keys, "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_base") for c in sums], *[F.lead(f"_f_{n}").over(by_range).alias(f"_f_{n}") for n in following])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    own = inside.rowsBetween(Window.unboundedPreceding, -1)
    worked = placed.withColumns(
        {f"_w_{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in before.items()}
        | {f"_l_{n}": F.lead(F.struct(c.alias("v"))).over(inside) for n, c in following.items()}
        | ({"_p": F.row_number().over(inside) - 1} if position else {})
    )
    bases = bases.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_range": "_of_range"})
    met = worked["_range"] == bases["_of_range"]
    for k in keys:
        met &= worked[k].eqNullSafe(bases[f"_k_{k}"])
    joined = worked.join(bases, met)
    found = {n: F.col(f"_w_{n}") + F.col(f"_t_{n}_base") for n in before} | {n: F.coalesce(f"_l_{n}", f"_f_{n}").getField("v") for n in following} | ({position: F.col("_p") + F.col("_n_base")} if position else {})
    return joined.select(*[c for c in rows.columns if c not in found], *[c.alias(n) for n, c in found.items()])
