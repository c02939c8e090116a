"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.scratch import Scratch


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (least node reachable) of every node of ``edges`` (u, v: long).

    Alternates large stars (each node ties its greater neighbours to its least neighbour) and small
    stars (each node ties its lesser neighbours and itself to the least of them) until nothing changes,
    when every node is tied to the least of its component. Minima are aggregated before the shuffle and
    joined back, so a node of many edges is split like any skewed join. Null ends are ignored. A round's
    tables are deleted when the next one's are written; ``most_rounds``, far over what the logarithm of any
    number of nodes asks for, ends the job with an error rather than leave links out.
    """
    scratch = Scratch(edges.sparkSession)
    held = scratch.save(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for turn in range(most_rounds):
        state = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
        both = held.unionAll(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"large-star-{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        held = scratch.save(small.where(F.col("u") != F.col("v")).distinct(), f"small-star-{turn}")
        scratch.keep_only(f"small-star-{turn}")
    else:
        raise RuntimeError("components did not settle")
    roots = held.select(F.col("v").alias("node")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
