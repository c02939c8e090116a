"""Synthetic containers, written here byte by byte and read back field by field."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from leafspark.functions import binary, codecs, rules
from leafspark.operators import documents, keyed, layout, nav, search, styles
from leafspark.sources import files, palm
from leafspark.streaming import arriving_headers

TEXT = "A first part of the text, é included. " * 5


def container(kind: bytes, records: list[bytes], name: bytes = b"Sample") -> bytes:
    head = name.ljust(32, b"\0") + struct.pack(">HH", 8, 1) + bytes(24) + kind + b"Test" + bytes(8) + struct.pack(">H", len(records))
    at, entries = 78 + 8 * len(records), b""
    for i, r in enumerate(records):
        entries += struct.pack(">IB", at, i) + bytes(3)
        at += len(r)
    return head + entries + b"".join(records)


def current_head(flags: int = 0b0110, encoding: int = 106, starts=(0, 3, 4, 0), counts=(0, 0, 1, 0)) -> bytes:
    head = bytearray(128)
    head[0:2], head[2:5], head[6:12] = struct.pack(">H", 128), bytes((4, 1, 0)), palm.RECORD_0_MAGIC.encode()
    head[20:24], head[24:26], head[36:38], head[38:40] = struct.pack(">i", -5), struct.pack(">H", 8), struct.pack(">H", flags), struct.pack(">H", encoding)
    groups = struct.pack(">H5H", 5, 1, 2, 3, 4, 5)
    ranges = struct.pack(">H", len(starts)) + b"".join(struct.pack(">H", x) for x in (*starts, *counts))
    return bytes(head) + groups + ranges


def text_record(text: bytes, flags: bytes = b"\x10\x20") -> bytes:
    body = bytearray(36)
    body[0:2] = b"\x04\x00"
    body[24 : 24 + len(flags)] = flags
    return bytes(body) + codecs.pack_words(text, 64)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("containers")
    raw = TEXT.encode()
    toc = b"\x04\x08" + struct.pack(">HBx", 7, 5) + b"Start"
    tree = bytes((4, 0, 0, 0, 4, 0, 0, 0)) + b"\x00\x0c\x00\x01" + bytes((16, 0, 0, 0, 0, 0, 0, 2)) + bytes(8) + b"\x09\x13"
    (top / "current.pdb").write_bytes(container(b"SDoc", [current_head(), text_record(raw[:97]), text_record(raw[97:]), toc, tree], b"Current\0rest"))
    (top / "doc.PDB").write_bytes(container(b"TEXt", [struct.pack(">HHiHHi", 2, 0, 5, 2, 4096, 0) + b"Old title\0", codecs.pack_palmdoc(b"one "), codecs.pack_palmdoc(b"two")]))
    (top / "early.pdb").write_bytes(container(b"ToGo", [struct.pack(">HH", 2, 0x8004) + b"\x03Two\x02Me", b"plain \xe9", b"\x80 end"]))
    (top / "empty.pdb").write_bytes(container(b"SDoc", []))
    (top / "cut.pdb").write_bytes(container(b"SDoc", [b"abc", b"de"])[:80])
    (top / "odd.pdb").write_bytes(container(b"Else", [b"\0\1"]))
    (top / "notes.txt").write_bytes(b"no container")
    return str(top)


@pytest.fixture(scope="module")
def opened(spark, folder):
    return {k: v.cache() for k, v in documents.open_folder(spark, folder).items()}


def by_name(rows):
    return {r["path"].rsplit("/", 1)[1]: r for r in rows}


def test_listing(spark, folder):
    listed = files.read_files(spark, [folder, folder]).select("name", "length")
    assert listed.count() == 12  # folders aren't deduplicated
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert [r["name"] for r in files.in_name_order(listed.distinct(), "name", "length").collect()][:2] == ["current.pdb", "cut.pdb"]


def test_headers_and_records(opened):
    heads = by_name(opened["headers"].collect())
    assert heads["current.pdb"]["name"] == "Current" and heads["current.pdb"]["type"] == "SDoc" and heads["current.pdb"]["record_count"] == 5
    assert heads["current.pdb"]["attributes"] == 8 and heads["current.pdb"]["creator"] == "Test"
    assert {n: r["format"] for n, r in heads.items()} == {"current.pdb": 3, "doc.PDB": 5, "early.pdb": 2, "empty.pdb": 3, "cut.pdb": 3, "odd.pdb": 0}
    recs = [r for r in opened["records"].collect() if r["path"].endswith("early.pdb")]
    assert [(r["idx"], r["attr"], bytes(r["data"])) for r in sorted(recs, key=lambda r: r["idx"])][1:] == [(1, 1, b"plain \xe9"), (2, 2, b"\x80 end")]
    assert {r["path"].rsplit("/", 1)[1] for r in opened["diagnostics"].collect()} == {"empty.pdb", "cut.pdb", "odd.pdb"}


def test_a_broken_extent_leaves_other_records(spark):
    raw = bytearray(container(b"SDoc", [b"abc", b"de", b"f"]))
    raw[78 + 8 : 78 + 12] = struct.pack(">I", 5000)
    heads = palm.headers(spark.createDataFrame([("x", bytes(raw))], "path string, content binary"))
    assert [r["data"] and bytes(r["data"]) for r in palm.records(heads).orderBy("idx").collect()] == [None, None, b"f"]


def test_documents(opened):
    docs = by_name(opened["documents"].collect())
    assert docs["current.pdb"]["text"] == TEXT and docs["current.pdb"]["charset"] == "UTF-8" and docs["current.pdb"]["title"] == "Current"
    assert docs["current.pdb"]["text_bytes"] == len(TEXT.encode()) and docs["current.pdb"]["text_chars"] == len(TEXT)
    assert docs["doc.PDB"]["text"] == "one two" and docs["doc.PDB"]["title"] == "Old title"
    assert docs["early.pdb"]["text"] == "plain é€ end" and docs["early.pdb"]["title"] == "Two"
    assert "odd.pdb" not in docs


def test_contents_and_pages(opened):
    assert [(r["title"], r["target_offset"]) for r in opened["contents"].collect()] == [("Start", 7)]
    assert [r["start"] for r in opened["page_offsets"].orderBy("page_idx").collect()] == [10, 30]
    assert [r["start"] for r in documents.paging(opened["page_offsets"]).orderBy("page_idx").collect()] == [0, 10, 30]


def test_contents_fall_back_on_the_named_range(spark):
    raw = container(b"SDoc", [current_head(starts=(0, 2, 0, 0), counts=(0, 1, 0, 0)), b"\x04\x07" + bytes(6), struct.pack(">HBx", 3, 2) + b"Hi"])
    heads = palm.headers(spark.createDataFrame([("x", raw)], "path string, content binary"))
    assert [(r["title"], r["target_offset"]) for r in documents.contents(heads).collect()] == [("Hi", 3)]


def test_record_0(spark):
    head = spark.createDataFrame([("x", current_head()), ("short", current_head()[:130]), ("bad", b"\0" * 200)], "path string, head binary")
    rows = {r["path"]: r for r in palm.current_layout(head).collect()}
    x = rows["x"]
    assert x["valid"] and x["text_size"] == -5 and x["charset"] == "UTF-8" and x["has_toc"] and x["encrypted"] and x["compressed"] and not x["has_images"]
    assert x["group_a"] == [1, 2, 3, 4] and x["record_starts"][:4] == [0, 3, 4, 0] and x["record_counts"][:4] == [0, 0, 1, 0]
    assert rows["short"]["valid"] and set(rows["short"]["record_starts"]) == {0} and not rows["bad"]["valid"]


def test_styled_runs(spark, opened):
    rows = [tuple(r)[1:] for r in opened["text_runs"].orderBy("run_idx").collect() if r["path"].endswith("current.pdb")]
    total = len(TEXT.encode())
    assert sum(r[2] for r in rows) == total and rows[0][1] == 0
    assert {r[3] for r in rows} <= {0, 1, 2, 3}


def test_spans_edge_cases(spark):
    spans = spark.createDataFrame([("a", 0, 3, 1), ("a", 1, 3, 2), ("a", 2, 99, 3), ("a", 3, 8, 0)], "k string, span_idx int, offset long, style_id int")
    totals = spark.createDataFrame([("a", 8), ("b", 4), ("c", 0)], "k string, total long")
    rows = [tuple(r) for r in styles.runs_of_spans(spans, totals, "k", "total").orderBy("k", "run_idx").collect()]
    assert rows == [("a", 0, 0, 3, 0), ("a", 1, 3, 5, 2), ("b", 0, 0, 4, 0)]


def test_long_span_offsets_do_not_wrap(spark):
    recs = spark.createDataFrame([("a", 1, 70_000, [5, 0, 6], bytearray(b"\x10\x20\x70"))], "path string, seq int, base_offset long, block_sizes array<int>, flags binary")
    assert [tuple(r)[1:] for r in styles.block_spans(recs, "path").collect()] == [(0, 70_000, 1), (1, 70_005, 3)]


def test_wrap():
    lines = lambda t, w: [t[a : a + n] for a, n in layout.wrap_text(t, w)]
    assert lines("", 5) == [""] and lines("aa bb\n", 10) == ["aa bb"] and lines("aa bb cc", 5) == ["aa bb", "cc"]
    assert lines("abcdefgh", 3) == ["abc", "def", "gh"] and lines("a\n\nb", 5) == ["a", "", "b"] and lines("ab\tcd", 3) == ["ab", "cd"]
    long = "word " * 900
    assert "".join(lines(long, 40)).replace(" ", "") == long.replace(" ", "")  # every character but breaks is on a line


def test_pages_by_height(spark):
    lines = spark.createDataFrame([(1, i, h) for i, h in enumerate([30, 30, 50, 200, 10])] + [(2, 0, 10)], "k int, line_idx int, height int")
    assert [r["page_idx"] for r in layout.pages_by_height(lines, "k", 100).orderBy("k", "line_idx").collect()] == [0, 0, 1, 2, 3, 0]


def test_binary_functions(spark):
    one = spark.createDataFrame([(bytearray(b"\x00\x01\xff\xff\xff\xfe"), "  42x", "99999999999", "", "ab\0c")], "b binary, n string, big string, none string, s string")
    r = one.select(
        binary.u16(F.col("b"), 0), binary.i32(F.col("b"), 2), binary.u32(F.col("b"), 2), binary.u16(F.col("b"), 5), binary.hex_dump(F.col("b"), 1, 3),
        binary.parse_unsigned(F.col("n")), binary.parse_unsigned(F.col("big")), binary.parse_unsigned(F.col("none")), binary.until_nul(F.col("s")), binary.byte_slice(F.col("b"), 6, 2),
    ).first()
    assert list(r) == [1, -2, 2**32 - 2, None, "01 FF FF", 42, -1, 0, "ab", None]
    every = spark.createDataFrame([(bytearray(range(256)),)], "b binary").select(binary.windows_1252(F.col("b"))).first()[0]
    assert every[:128] == bytes(range(128)).decode() and every[0xA0:] == bytes(range(0xA0, 256)).decode("latin-1")
    assert every[0x80:0xA0] == bytes(range(0x80, 0xA0)).decode("cp1252", "replace").replace("\x81", "�")


def test_screen_and_links(spark):
    points = spark.createDataFrame([("a", 5), ("a", 50)], "k string, pos long")
    links = spark.createDataFrame([("a", 0, 0, 10, 7), ("a", 1, 4, 10, 9)], "k string, link_idx int, char_offset long, length long, target_offset long")
    assert [tuple(r) for r in nav.link_at(points, links, "k", "pos").collect()] == [("a", 5, 7, 0)]
    row = spark.range(1).select(rules.page_label(F.lit(2), F.lit(9)), rules.page_label(F.lit(2), F.lit(0))).first()
    assert list(row) == ["Página 3/9", "Página 3"]


def test_matches_without_regard_to_case_where_lowering_changes_lengths(spark):
    texts = ["İİ find ME here", "no", "FIND me", "x\n(İ) find\nme Find Me", None, "ÉFIND ME"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for query, start in (("find me", 0), ("Find Me", 2)):
        got = {r["k"]: (r["char_offset"], r["byte_offset"], r["byte_length"]) for r in search.find_first(docs, query, start, ignore_case=True).collect()}
        want = {}
        for k, t in enumerate(texts):
            for i in range(start, len(t or "")):
                part = t[i : i + len(query)]
                if part.upper() == query.upper():
                    want[k] = (i, len(t[:i].encode()), len(part.encode()))
                    break
        assert got == want


@pytest.mark.parametrize("step", [4, 4096])
def test_spans_meet_over_steps(spark, monkeypatch, step):
    monkeypatch.setattr(nav, "STEP", step)
    lines = [(1, i, a, b) for i, (a, b) in enumerate([(0, 5), (5, 5), (5, 12), (12, 30), (30, 31)])]
    runs = [(1, i, a, b) for i, (a, b) in enumerate([(0, 7), (7, 8), (8, 29), (29, 40)])]
    frame = lambda rows, name: spark.createDataFrame(rows, f"k int, {name} int, start long, end long")
    got = sorted(tuple(r) for r in nav.overlaps(frame(lines, "line_idx"), frame(runs, "run_idx"), "k").collect())
    assert got == sorted((1, i, j, max(a, c), min(b, d)) for _, i, a, b in lines for _, j, c, d in runs if a < d and c < b)
    points = spark.createDataFrame([(1, p) for p in range(-1, 42)], "k int, at long")
    got = sorted(tuple(r) for r in nav.within(points, frame(runs, "run_idx"), "k", "at", "inner").select("at", "run_idx").collect())
    assert got == sorted((p, j) for p in range(-1, 42) for _, j, c, d in runs if c <= p < d)
    assert nav.within(points, frame(runs, "run_idx"), "k", "at").count() == 43


def test_records_past_the_end_are_reported(spark):
    raw = container(b"SDoc", [b"abc", b"de", b"f"])
    recs = palm.records(palm.headers(spark.createDataFrame([("x", raw[:-2])], "path string, content binary")))
    assert [tuple(r) for r in palm.record_failures(recs).collect()] == [("x", "record", palm.SHORT_READ, "record 1 is cut off"), ("x", "record", palm.SHORT_READ, "record 2 is cut off")]


def test_keyed_table_limits(spark):
    table = spark.createDataFrame([("Night",)], "name string")
    new = spark.createDataFrame([("NIGHT", 1), ("Day", 2), ("day", 3), ("x" * 32, 4), ("", 5)], "name string, k int")
    assert [tuple(r) for r in keyed.insert_absent(table, new, "name").collect()] == [("Day", 2)]
    with pytest.raises(ValueError):
        keyed.insertion_points(table, spark.range(5000).select(F.col("id").cast("string").alias("n")), "name", "n")


def test_arriving_containers(spark, folder, tmp_path):
    query = arriving_headers(spark, folder).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_empty_folder_tables(spark):
    none = spark.createDataFrame([], "path string, content binary")
    assert documents.documents(palm.headers(none)).count() == 0
