"""Lookups by text offset: pages, runs, lines and links. All keep rows of one document together."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_pages(docs: DataFrame, key: str, length: str, step: int) -> DataFrame:
    """Starts of pages of ``step`` characters: key, page_idx, start, and the text's total length."""
    starts = F.sequence(F.lit(0), F.greatest(F.col(length).cast("int") - 1, F.lit(0)), F.lit(step))
    return docs.select(key, F.col(length).cast("long").alias("total"), F.posexplode(starts).alias("page_idx", "start")).withColumn("start", F.col("start").cast("long"))


def page_extents(pages: DataFrame, key: str, total: str) -> DataFrame:
    """Each page with its end: the next start, or ``total`` for the last; empty pages go."""
    order = Window.partitionBy(key).orderBy("start", "page_idx")
    return pages.withColumn("end", F.lead("start").over(order)).withColumn("end", F.coalesce("end", F.col(total)).cast("long")).where(F.col("end") > F.col("start"))


def page_at(queries: DataFrame, pages: DataFrame, key: str, offset: str) -> DataFrame:
    """``queries`` with page_idx: the last page that starts at or before the offset, else 0.

    One sort by document and offset; no range join. A query without a page before it has page 0.
    """
    asked = queries.select("*", F.col(offset).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_page"))
    given = pages.select(key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("page_idx").cast("int").alias("_page"))
    order = Window.partitionBy(key).orderBy("_at", "_kind", "_page").rowsBetween(Window.unboundedPreceding, 0)
    merged = asked.unionByName(given, allowMissingColumns=True).withColumn("page_idx", F.coalesce(F.last("_page", True).over(order), F.lit(0)))
    return merged.where(F.col("_kind") == 1).drop("_at", "_kind", "_page")


def flow_page_at(queries: DataFrame, extents: DataFrame, key: str, offset: str) -> DataFrame:
    """page_idx of the page whose extent holds the offset; the last page past the end, else 0."""
    ends = extents.groupBy(key).agg(F.max("end").alias("_total"), F.max("page_idx").alias("_last"))
    placed = page_at(queries, extents, key, offset).join(ends, key, "left")
    return placed.withColumn("page_idx", F.coalesce(F.when(F.col(offset) >= F.col("_total"), F.col("_last")), F.col("page_idx"), F.lit(0)).cast("int")).drop("_total", "_last")


def with_starts(parts: DataFrame, key: str, order: str, length: Column) -> DataFrame:
    """Start of each part in its document: the lengths before it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def run_at(queries: DataFrame, runs: DataFrame, key: str, offset: str) -> DataFrame:
    """run_idx of the run that holds the offset; the last run past the end. Runs have run_idx and start, and fill the text."""
    pages = runs.select(key, F.col("run_idx").alias("page_idx"), "start")
    return page_at(queries, pages, key, offset).withColumnRenamed("page_idx", "run_idx")


#: Characters of a document whose points and spans are held against each other.
STEP = 4096


def _stepped(spans: DataFrame) -> DataFrame:
    """Spans once for each step of offsets that they touch (an empty one touches the step it is in)."""
    upto = F.greatest(F.col("end") - 1, F.col("start"))
    return spans.withColumn("_step", F.explode(F.sequence(F.floor(F.col("start") / STEP), F.floor(upto / STEP))))


def within(points: DataFrame, spans: DataFrame, key: str, offset: str, how: str = "left") -> DataFrame:
    """Points with every span (start, end) of their document that holds them; met by document and step of offsets."""
    s = _stepped(spans.where(F.col("end") > F.col("start"))).withColumnsRenamed({key: "_key", "_step": "_of"})
    hit = (F.col(key) == F.col("_key")) & (F.col("_step") == F.col("_of")) & (F.col("start") <= F.col(offset)) & (F.col(offset) < F.col("end"))
    return points.withColumn("_step", F.floor(F.col(offset) / STEP)).join(s, hit, how).drop("_key", "_of", "_step")


def link_at(points: DataFrame, links: DataFrame, key: str, offset: str) -> DataFrame:
    """Target of the first link (least link_idx) over each point; points without one go. ``points`` need not be unique."""
    spans = links.select(key, "link_idx", "target_offset", F.col("char_offset").alias("start"), (F.col("char_offset") + F.col("length")).alias("end"))
    hits = within(points, spans, key, offset, "inner")
    return hits.groupBy(*points.columns).agg(F.min_by("target_offset", "link_idx").alias("target_offset"), F.min("link_idx").alias("link_idx"))


def overlaps(lines: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Parts of lines under one run each: key, line_idx, run_idx, seg_start, seg_end. Both sides have start and end.

    They meet by document and step of offsets; a part is kept in the step that it begins in.
    """
    a, b = _stepped(lines).alias("a"), _stepped(runs).alias("b")
    begin = F.greatest("a.start", "b.start")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._step") == F.col("b._step")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    met = a.join(b, on).where(F.floor(begin / STEP) == F.col("a._step"))
    return met.select(f"a.{key}", "line_idx", "run_idx", begin.alias("seg_start"), F.least("a.end", "b.end").alias("seg_end"))


def toc_links(toc: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """A link where each title first stands in its document; titles that are null, empty or not there give none.

    A document's different titles go to its text together and are looked for in one pass, by an automaton of them.
    """
    named = toc.where(F.col("title").isNotNull() & (F.col("title") != ""))
    titles = named.groupBy(key).agg(F.collect_set("title").alias("_titles"))
    met = titles.join(docs.select(key, F.col("text").alias("_text")).where("_text IS NOT NULL"), key)
    kind = docs.schema[key].dataType.simpleString()
    found = met.select(key, "_titles", "_text").mapInArrow(_first_places, f"_key {kind}, _title string, _at long")
    at_title = (F.col(key) == F.col("_key")) & (F.col("title") == F.col("_title"))
    return named.join(found, at_title).select(key, "entry_idx", "title", F.col("_at").alias("char_offset"), F.length("title").cast("long").alias("length"), "target_offset")


#: Characters of texts whose titles are Python objects at once.
HELD_CHARS = 1 << 20


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, title and first character of every title that stands in its row's text; handed on when so many characters were read."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(titles, pa.string()), pa.array(places, pa.int64())], names=["_key", "_title", "_at"])

    for batch in batches:
        rows, titles, places, size = [], [], [], 0
        for row, (asked, text) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            body = text.as_py()
            for title, at in first_places(asked.as_py(), body).items():
                rows.append(row)
                titles.append(title)
                places.append(at)
            size += len(body)
            if size >= HELD_CHARS:
                yield found(batch)
                rows, titles, places, size = [], [], [], 0
        yield found(batch)


def first_places(titles: list[str], text: str) -> dict[str, int]:
    """Where each title first begins in a text; those that aren't there are left out."""
    automaton = ahocorasick.Automaton()
    for title in titles:
        automaton.add_word(title, title)
    automaton.make_automaton()
    found: dict[str, int] = {}
    for end, title in automaton.iter(text):
        if title not in found:
            found[title] = end + 1 - len(title)
            if len(found) == len(titles):
                break
    return found


def running_offsets(deltas: DataFrame, keys: list[str], order: str, delta: Column) -> DataFrame:
    """Offsets from deltas: a running sum within ``keys``."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("offset", F.sum(delta).over(upto).cast("long"))


def first_or_fallback(found: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """``found``, and of ``fallback`` the documents that it has nothing of."""
    return found.unionByName(fallback.join(found.select(key).distinct(), key, "left_anti"))


def tapped_char(x: Column, left: Column, size: Column, start: Column, length: Column) -> Column:
    """Character of a line under a tap, at 0.6 of the font size each, held to the line."""
    step = F.greatest(F.floor((x - left) / (size * 0.6)), F.lit(0))
    return F.least(start + step, start + F.greatest(length - 1, F.lit(0))).cast("long")
