"""Ordered edits of small keyed tables: insertion under limits, and deletion by position, as state of each table."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.operators.keyed import MOST_NAME, MOST_THEMES

#: Bytes of a table, the greatest id, and the code of an edit that a table doesn't take.
MOST_BYTES, MOST_ID, REJECTED = 32_000, 32_767, -2027749349


@dataclass
class State:
    """A table in order of names (case aside): names as they are compared, their sizes and ids, the bytes of all, and the id to be tried next."""

    names: list[bytes] = field(default_factory=list)
    rows: list[tuple[str, int, int]] = field(default_factory=list)  # name, bytes, id
    bytes: int = 0
    next_id: int = 1

    def insert(self, name: str | None, size: int, own_id: int | None = None) -> tuple[int, int | None, int | None]:
        """Code, id and position. The first free id from ``next_id`` on is taken, in a circle from 1 to MOST_ID."""
        if not name or len(name) > MOST_NAME or len(self.names) >= MOST_THEMES:
            return REJECTED, None, None
        key = name.lower().encode()
        at = bisect_left(self.names, key)
        if at < len(self.names) and self.names[at] == key:
            return REJECTED, None, None
        if own_id is None:
            used, own_id = {r[2] for r in self.rows}, self.next_id
            while own_id in used:
                own_id = own_id % MOST_ID + 1
            self.next_id = own_id % MOST_ID + 1
        if self.bytes + size > MOST_BYTES:
            return REJECTED, None, None
        self.names.insert(at, key)
        self.rows.insert(at, (name, size, own_id))
        self.bytes += size
        return 0, own_id, at

    def delete(self, at: int | None) -> tuple[int, int | None, int | None]:
        if at is None or not 0 <= at < len(self.names):
            return REJECTED, None, None
        _, size, own_id = self.rows.pop(at)
        self.names.pop(at)
        self.bytes -= size
        return 0, own_id, at


def apply_edits(tables: DataFrame, edits: DataFrame, key: str, order: str, after: bool = False, first_id: int = 1) -> DataFrame:
    """Apply ``edits`` to ``tables``, each table's in ``order``.

    ``tables`` has the key, name, bytes and theme_id; ``edits`` the key, the order (a number that tells a table's edits apart), name and bytes of a
    row to be inserted, and position, which if it isn't null says that the row of that place (from 0, in order of names) is deleted. A table takes
    MOST_THEMES rows and MOST_BYTES at most, and names of 1 to MOST_NAME characters that it lacks (case aside). Edits of a table that isn't there begin one.

    Returns key, order, code (0 or REJECTED), theme_id and position of every edit, or with ``after`` the key, name, bytes, theme_id and position of
    every row of the tables afterwards. A table's state is a few thousand rows at most; its edits stream through it in sorted order and aren't held.
    """
    kind, number = (edits.schema[c].dataType.simpleString() for c in (key, order))
    none = lambda t: F.lit(None).cast(t)
    held = tables.select(F.col(key).cast(kind).alias(key), F.lit(0).alias("_kind"), none(number).alias(order), "name", F.col("bytes").cast("int").alias("bytes"), none("int").alias("position"), F.col("theme_id").cast("int").alias("theme_id"))
    asked = edits.select(key, F.lit(1).alias("_kind"), order, "name", F.col("bytes").cast("int").alias("bytes"), F.col("position").cast("int").alias("position"), none("int").alias("theme_id"))
    dealt = held.unionAll(asked).repartition(key).sortWithinPartitions(key, "_kind", order)
    schema = f"{key} {kind}, name string, bytes int, theme_id int, position int" if after else f"{key} {kind}, {order} {number}, code int, theme_id int, position int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), State(next_id=first_id)

        def left() -> list[tuple]:
            return [(current, *r, i) for i, r in enumerate(state.rows)]

        for batch in batches:
            out = []
            for k, given, at, name, size, position, own_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != current:
                    if after:
                        out += left()
                    current, state = k, State(next_id=first_id)
                if given == 0:
                    state.insert(name, size or 0, own_id)
                else:
                    done = state.insert(name, size or 0) if position is None else state.delete(position)
                    if not after:
                        out.append((k, at, *done))
            if out:
                yield listed(out)
        if after and state.rows:
            yield listed(left())

    arrow_key = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    i32 = pa.int32()

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        types = [arrow_key[kind], pa.string(), i32, i32, i32] if after else [arrow_key[kind], arrow_key[number], i32, i32, i32]
        titles = [key, "name", "bytes", "theme_id", "position"] if after else [key, order, "code", "theme_id", "position"]
        return pa.record_batch([pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=titles)

    if kind not in arrow_key or number not in arrow_key:
        raise ValueError("keys and orders are strings, ints or longs")
    return dealt.mapInArrow(run, schema)
