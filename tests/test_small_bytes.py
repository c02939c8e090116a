"""Comparisons, seeks, written values and records by number against plain Python."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from leafspark.functions import binary
from leafspark.sources import palm
from tests.test_containers import container


def first_difference(a, b, value):
    for x, y in zip(a, b, strict=False):
        x, y = value(x), value(y)
        if x is None or y is None:
            return binary.FAILED
        if x != y:
            return 2 if x < y else 3
    return 0 if len(a) == len(b) else 2 if len(a) < len(b) else 3


def pairs():
    rng = random.Random(5)
    some = [bytes(rng.choice(b"aAbB\x00@[\x7f\x80\xff") for _ in range(rng.randrange(5))) for _ in range(250)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(some, [*some[1:], some[0]], strict=True))] + [(-1, b"", b""), (-2, None, b"x"), (-3, b"a" * 100_000, b"A" * 100_000 + b"\xff")]


def test_comparisons(spark):
    frame = spark.createDataFrame(pairs(), "i int, a binary, b binary")
    got = {r["i"]: (r["s"], r["c"]) for r in frame.select("i", binary.compare_signed(F.col("a"), F.col("b")).alias("s"), binary.compare_ascii(F.col("a"), F.col("b")).alias("c")).collect()}
    folded = lambda x: None if x > 127 else x + 32 if 65 <= x <= 90 else x
    for i, a, b in pairs():
        if a is not None:
            assert got[i] == (first_difference(a, b, lambda x: x - 256 if x > 127 else x), first_difference(a, b, folded)), (a, b)


def test_seeks_stay_within(spark):
    rows = [(size, at, offset, mode) for size in (0, 10) for at in (0, 4) for offset in (-20, -1, 0, 3, 20) for mode in range(-1, 4)]
    frame = spark.createDataFrame(rows, "size long, at long, off long, mode int")
    for r in frame.withColumn("s", binary.sought(*(F.col(c) for c in ("size", "at", "off", "mode")))).collect():
        if r["mode"] in (0, 1, 2):
            asked = (0, r["at"], r["size"])[r["mode"]] + r["off"]
            assert tuple(r["s"]) == (max(0, min(asked, r["size"])), 0)
        else:
            assert tuple(r["s"]) == (r["at"], binary.UNSUPPORTED)


def test_written_values(spark):
    rows = [([1, -1, 65535], [-(2**31), 7], "a\u00e9\U0001f600"), ([], [], "")]
    frame = spark.createDataFrame(rows, "s array<int>, w array<long>, t string")
    got = frame.select("s", "w", "t", binary.integers(F.col("s"), 2).alias("a"), binary.integers(F.col("w"), 4).alias("b"), binary.utf16(F.col("t")).alias("c")).collect()
    for r in got:
        assert bytes(r["a"]) == b"".join(struct.pack(">H", x & 0xFFFF) for x in r["s"])
        assert bytes(r["b"]) == b"".join(struct.pack(">i", x) for x in r["w"])
        assert bytes(r["c"]) == r["t"].encode("utf-16-be")


def test_records_by_number(spark):
    records = [b"zero", b"", b"two" * 9]
    whole = container(b"TEXt", records)
    files = [("whole", whole), ("cut", whole[:-20][: 78 + 24 + 4]), ("short", b"x" * 20), ("none", container(b"TEXt", []))]
    frame = palm.headers(spark.createDataFrame(files, "path string, content binary"))
    for i, data in [(-1, None), *enumerate(records), (3, None)]:
        got = {r["path"]: r for r in palm.record_at(frame, F.lit(i), "name").collect()}
        assert len(got) == 4 and got["short"]["code"] == got["none"]["code"] == palm.CORRUPT
        assert (got["whole"]["code"], got["whole"]["data"]) == ((palm.NO_RECORD, None) if data is None else (0, bytearray(data)))
        assert got["cut"]["data"] is None or bytes(got["cut"]["data"]) == records[i][: len(got["cut"]["data"])]
    assert [r["code"] for r in palm.record_at(frame, F.lit(None)).where("path = 'whole'").collect()] == [palm.NO_RECORD]
