"""Table functions and codecs of nested records: style records walked entry by entry, and theme tables by their layout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The least stride of style entries, and the first byte at which they can be described.
LEAST_STRIDE, LEAST_HEAD = 8, 4


@F.udtf(returnType="entry int, style_id int, extra int, first int, second int, third int, reason string")
class StyleEntries:
    """Entries of a style record, and rows with a reason (and no values) for what can't be read.

    Byte 0 says where the description begins: there stand the step to the first entry, and two bytes on the number of entries
    and the base of their stride. ``recs.lateralJoin(StyleEntries(F.col("data").outer()))`` gives them beside their records.
    """

    def eval(self, record: bytes | None) -> Iterator[tuple]:
        def lost(entry: int, reason: str) -> tuple:
            return entry, None, None, None, None, None, reason

        if record is None or len(record) < 8:
            yield lost(0, "record too short")
            return
        head = record[0]
        if head < LEAST_HEAD or head + 4 > len(record):
            yield lost(0, "no description")
            return
        at, count, base = head + record[head], record[head + 2], record[head + 3]
        for i in range(count):
            if at + 8 > len(record):
                yield lost(i, f"{count - i} entries cut off")
                return
            number = lambda k: int.from_bytes(record[at + k : at + k + 2], "big")  # noqa: B023, E731
            yield i, record[at], record[at + 1], number(2), number(4), number(6), None
            at += max(LEAST_STRIDE, base + ((record[at + 1] + 2) & 0xFFFE))


#: Layouts of nested records: in order, fields of so many bytes (big-endian, unsigned), counts of a part that comes later, strings of
#: UTF-16 units, and lists of records.
COLOUR = (("idx", 1), ("r", 1), ("g", 1), ("b", 1))
THEME = (("id", 2), ("colours", "count"), ("name", "count"), ("name", "text"), ("colours", COLOUR))
TABLE = (("bytes", 2), ("themes", "wide count"), ("next_id", 2), ("flags", 2), ("themes", THEME))


def packed(value: dict, layout: tuple) -> bytes:
    """A record's bytes by its layout; numbers and counts that don't fit are an error."""
    out = []
    for name, kind in layout:
        if kind in ("count", "wide count"):
            part = () if value[name] is None else value[name]
            n = len(part.encode("utf-16-be")) // 2 if isinstance(part, str) else len(part)
            out.append(n.to_bytes(1 if kind == "count" else 2, "big"))
        elif kind == "text":
            out.append((value[name] or "").encode("utf-16-be"))
        elif isinstance(kind, tuple):
            out.extend(packed(x, kind) for x in (() if value[name] is None else value[name]))
        else:
            out.append((value[name] or 0).to_bytes(kind, "big"))
    return b"".join(out)


def unpacked(data: bytes, layout: tuple, at: int = 0) -> tuple[dict, int] | None:
    """A record and where it ends; None if it passes the end of the bytes."""
    value: dict = {}
    counts: dict[str, int] = {}
    for name, kind in layout:
        if kind == "text":
            end = at + 2 * counts[name]
            if end > len(data):
                return None
            value[name], at = data[at:end].decode("utf-16-be", "replace"), end
        elif isinstance(kind, tuple):
            rows = []
            for _ in range(counts[name]):
                found = unpacked(data, kind, at)
                if found is None:
                    return None
                rows.append(found[0])
                at = found[1]
            value[name] = rows
        else:
            size = {"count": 1, "wide count": 2}.get(kind, kind)
            if at + size > len(data):
                return None
            number, at = int.from_bytes(data[at : at + size], "big"), at + size
            (value if isinstance(kind, int) else counts)[name] = number
    return value, at


def _numbers(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in names])


THEME_TYPE = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("colours", T.ArrayType(_numbers("idx", "r", "g", "b")))])
TABLE_TYPE = _numbers("bytes", "next_id", "flags").add("themes", T.ArrayType(THEME_TYPE))


#: Tables that are Python objects at once.
HELD_TABLES = 16


def _in_few(parts: Iterator[pa.Array], work: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """Results of ``work`` on the values of arrays, few at a time."""
    for s in parts:
        for at in range(0, len(s), HELD_TABLES):
            yield pa.array([work(x.as_py()) for x in s.slice(at, HELD_TABLES)], kind)


@F.arrow_udf(T.BinaryType())
def pack_themes_udf(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Bytes of theme tables (bytes, next_id, flags, themes); the field ``bytes`` is worked out, whatever it holds."""

    def table(row: dict) -> bytes:
        size = sum(len(packed(x, THEME)) for x in row["themes"])
        return packed({**row, "bytes": size}, TABLE)

    yield from _in_few(parts, table, pa.binary())


@F.arrow_udf(TABLE_TYPE)
def unpack_themes_udf(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Theme tables of bytes; a table that is cut off is null in all fields."""
    none = dict.fromkeys(("bytes", "next_id", "flags", "themes"))

    def table(data: bytes | None) -> dict:
        found = None if data is None else unpacked(data, TABLE)
        return none if found is None else found[0]

    yield from _in_few(parts, table, to_arrow_type(TABLE_TYPE))
