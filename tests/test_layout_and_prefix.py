"""Wrap by widths, pages by heights and on demand, sums in two levels, and titles looked for together, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafspark.operators import layout, nav, prefix

WIDE = layout.Measures(np.array([32, 97, 1 << 21 | 97]), np.array([3, 5, 9]), np.array([7, 8, 4]), np.array([10, 20, 30]), np.array([8, 15, 1]))


def plain_lines(text, style, m, limit, first=0):
    """One character after the other."""
    known = {int(k): int(w) for k, w in zip(m.keys, m.widths, strict=True)}
    wide = [known.get(s << 21 | ord(c), int(m.other[s])) for c, s in zip(text, style, strict=True)]
    starts, at = [], 0
    while True:
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        while sum(wide[at:end]) > limit:
            room = at
            while sum(wide[at : room + 1]) <= limit:
                room += 1
            cut = max(text.rfind(" ", at + 1, room + 1), text.rfind("\t", at + 1, room + 1))
            n = cut - at if cut > at else max(room - at, 1)
            starts.append((at, n))
            at += n + (cut > at)
        starts.append((at, end - at))
        at = end + 1
        if at >= len(text):
            break
    out = []
    for (a, n), (b, _) in zip(starts, [*starts[1:], (len(text), 0)], strict=True):
        own = style[a:b] or [style[a - 1] if text else first]
        out.append((a, n, sum(wide[a : a + n]), max(int(m.height[s]) for s in own), max(int(m.baseline[s]) for s in own)))
    return out


@given(st.text(alphabet="ab \t\né𐐷", max_size=60), st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 60))
@settings(max_examples=300, deadline=None)
def test_lines_by_widths(text, styles, limit):
    starts = [4 * i for i in range(len(styles))]
    style = [styles[min(i // 4, len(styles) - 1)] for i in range(len(text))]
    got = [tuple(int(x) for x in line) for line in zip(*layout.measured(text, starts, styles, limit, WIDE), strict=True)]
    assert got == plain_lines(text, style, WIDE, limit, styles[0])


@given(st.text(alphabet="ab \t\n", max_size=80), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_one_width_for_all_is_the_plain_wrap(text, width):
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    got = list(zip(*(x.tolist() for x in layout.wrapped(points, np.ones(len(points), dtype=np.int64), width)), strict=True))
    assert got == list(layout.wrap_text(text, width))


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 100), st.sampled_from([None, 30, 200]))
@settings(max_examples=200, deadline=None)
def test_page_starts(heights, most, chunk):
    offsets = np.cumsum(np.array(heights)) - heights[0]
    want, used = [], 0
    for i, h in enumerate(heights):
        if not want or used + h > most or (chunk and offsets[i] // chunk != offsets[i - 1] // chunk):
            want.append(i)
            used = 0
        used += h
    assert layout.page_starts(np.array(heights), offsets, most, chunk).tolist() == want


def documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 12)))
    texts = ["".join(word() + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(rng.randint(0, 400))) for _ in range(12)] + ["", None, "\n", "x" * 900]
    rows = [(i, t, [(31 * k, k % 3) for k in range(len(t or "") // 31 + 1)]) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, "k long, text string, runs array<struct<start:long,style_id:int>>")


def test_pages_on_demand_equal_the_whole_layout(spark):
    texts, docs = documents(spark)
    lines = layout.measured_lines(docs, "k", 150, WIDE)
    style = lambda t: [i // 31 % 3 for i in range(len(t))]
    got = sorted(tuple(r) for r in lines.collect())
    assert got == sorted((k, i, *line) for k, t in enumerate(texts) if t is not None for i, line in enumerate(plain_lines(t, style(t), WIDE, 150)))
    paged = layout.mixed_pages(lines, "k", 90, 300).cache()
    anchors = layout.page_anchors(paged, "k", every=3)
    asked = spark.createDataFrame([(k, p) for k in range(len(texts)) for p in (0, 1, 5, 7, 999)] + [(0, 1)], "k long, page_idx int")
    found = layout.pages_on_demand(docs, anchors, asked, "k", 150, WIDE, 90, 300, every=3)
    columns = ["k", "page_idx", "char_offset", "char_length", "width", "height", "baseline", "y"]
    want = paged.where("page_idx IN (0, 1, 5, 7)").select(columns)
    assert sorted(tuple(r) for r in found.select(columns).collect()) == sorted(tuple(r) for r in want.collect())
    pages = layout.pages_of(paged, "k").where("k = 0").orderBy("page_idx").collect()
    assert [r["page_idx"] for r in pages] == list(range(len(pages))) and all(r["content_height"] <= 90 or r["line_count"] == 1 for r in pages)


def test_only_the_part_behind_the_anchor_is_wrapped(spark):
    text = "word " * 4000
    docs = spark.createDataFrame([(1, text, [(0, 0)])], "k long, text string, runs array<struct<start:long,style_id:int>>")
    anchors = spark.createDataFrame([(1, 2, 10_000, 10_400)], "k long, block int, start long, end long")
    sizes = []
    whole = layout.measured_lines

    def spy(part, *args, **more):
        sizes.extend(r[0] for r in part.select(F.length("text")).collect())
        return whole(part, *args, **more)

    layout.measured_lines = spy
    try:
        layout.pages_on_demand(docs, anchors, spark.createDataFrame([(1, 17)], "k long, page_idx int"), "k", 150, WIDE, 90).collect()
    finally:
        layout.measured_lines = whole
    assert len(sizes) == 1 and 400 < sizes[0] < 500


def test_measures_are_checked(spark):
    styles = spark.createDataFrame([(0, 7, 10, 8), (2, 4, 30, 1)], "style_id int, width int, height int, baseline int")
    m = layout.measures(spark.createDataFrame([(0, 97, 5)], "style_id int, code_point int, width int"), styles)
    assert m.of(np.array([97, 98, 97]), np.array([0, 0, 1])).tolist() == [5, 7, 7] and m.height.tolist() == [10, 10, 30]
    with pytest.raises(ValueError):
        layout.measures(spark.createDataFrame([(0, 97, 0)], "style_id int, code_point int, width int"), styles)


def test_runs_meet_their_documents(spark):
    runs = spark.createDataFrame([(1, 5, 2), (1, 0, 1)], "k long, start long, style_id int")
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "x")], "k long, text string")
    rows = {r["k"]: r["runs"] for r in layout.with_runs(docs, runs, "k").collect()}
    assert [tuple(r) for r in rows[1]] == [(0, 1), (5, 2)] and rows[2] is None


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_sums_in_two_levels(spark, parts):
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), i, None if rng.random() < 0.1 else rng.randint(0, 9)) for i in range(2000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, at int, v int")
    found = prefix.in_two_levels(frame, ["k"], [F.col("at")], {"before": F.col("v")}, {"next": F.col("v")}, "position", parts)
    want = []
    for k in ("hot", "a", None):
        total, own = 0, sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for i, (_, at, v) in enumerate(own):
            want.append((k, at, v, total, own[i + 1][2] if i + 1 < len(own) else None, i))
            total += v or 0
    assert sorted(map(repr, (tuple(r) for r in found.select("k", "at", "v", "before", "next", "position").collect()))) == sorted(map(repr, want))
    places = prefix.limits(frame, [F.col("at")], parts)
    spread = frame.groupBy(prefix.range_of(frame, [F.col("at")], places)).count().collect()
    assert len(spread) == parts and max(r["count"] for r in spread) <= 2 * 2000 / parts


def test_order_of_several_columns_and_nothing_to_order(spark):
    rows = spark.createDataFrame([("x", n, i) for i, n in enumerate(["b", "A", "a", None, "B", "a"])], "k string, n string, i int")
    found = prefix.in_two_levels(rows, ["k"], [F.lower("n"), F.col("n"), F.col("i")], position="p", parts=4)
    assert [r["i"] for r in found.orderBy("p").collect()] == [3, 1, 2, 5, 4, 0]
    assert prefix.in_two_levels(rows.limit(0), ["k"], [F.col("i")], position="p").collect() == []


def test_titles_are_found_together(spark):
    assert nav.first_places(["ab", "b", "abc", "zz", "a\nb"], "xxabcab a\nb") == {"ab": 2, "b": 3, "abc": 2, "a\nb": 8}
    docs = spark.createDataFrame([(1, "one two one"), (2, None), (3, "")], "k long, text string")
    toc = spark.createDataFrame([(1, 0, "two", 5), (1, 1, "two", 6), (1, 2, None, 7), (1, 3, "", 8), (1, 4, "no", 9), (2, 0, "one", 1), (4, 0, "one", 1), (1, 5, "one", 2)], "k long, entry_idx int, title string, target_offset long")
    got = sorted(tuple(r) for r in nav.toc_links(toc, docs, "k").collect())
    assert got == [(1, 0, "two", 4, 3, 5), (1, 1, "two", 4, 3, 6), (1, 5, "one", 0, 3, 2)]
