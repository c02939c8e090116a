"""Font tables, style spans and text runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.functions.rules import FACE_MONO, FACE_SANS, FACE_SERIF, block_style

DOCUMENT_STYLES, ALL_STYLES = 13, 32
#: Font sizes of the default styles, two for each pair from 8 on.
DEFAULT_SIZES = (20, 20, 20, 20, 14, 14, 14, 14, 28, 28, 24, 24, 18, 18, 26, 26)


def font_style(base: Column, attributes: Column, i: Column) -> dict[str, Column]:
    """font_size, typeface, bold and italic of style ``i`` of a document's 13, by its base size and attributes."""
    size = F.when(base < 8, 20).otherwise(base).cast("int")
    face = lambda nibble, other: F.when(nibble.between(1, 5), nibble).otherwise(other)
    first = face(F.shiftright(attributes, 4).bitwiseAND(F.lit(15)), FACE_SERIF)
    second = face(attributes.bitwiseAND(F.lit(15)), FACE_SANS)
    scaled = lambda tenths: F.floor((size * tenths + 5) / 10).cast("int")
    sizes = (
        F.when(i.between(4, 7), F.greatest(scaled(7), F.lit(10)))
        .when(i.between(8, 9), F.least(scaled(14), F.lit(36)))
        .when(i.between(10, 11), F.least(scaled(12), F.lit(32)))
        .otherwise(size)
    )
    faces = F.when(i.between(4, 7), second).when(i == 12, FACE_MONO).otherwise(first)
    return {"font_size": sizes, "typeface": faces.cast("int"), "bold": i.isin(1, 3, 5, 7, 9, 11), "italic": i.isin(2, 3, 6, 7)}


def font_table(bases: DataFrame, base: str, attributes: str) -> DataFrame:
    """The 13 styles of each row of ``bases``: style_id, font_size, typeface, bold, italic."""
    listed = bases.withColumn("style_id", F.explode(F.sequence(F.lit(0), F.lit(DOCUMENT_STYLES - 1))))
    return listed.withColumns(font_style(F.col(base), F.col(attributes), F.col("style_id")))


def default_styles(spark: SparkSession) -> DataFrame:
    """The 32 styles that hold where a document has none of its own."""
    i = F.col("style_id")
    high = i >= 16
    sizes = F.when(high, 16).otherwise(F.element_at(F.array(*[F.lit(s) for s in DEFAULT_SIZES]), F.least(i, F.lit(15)) + 1))
    odd, second = (i % 2 == 1), (F.shiftright(i, 1) % 2 == 1)
    return spark.range(ALL_STYLES).select(F.col("id").cast("int").alias("style_id")).withColumns(
        {"font_size": sizes, "typeface": F.lit(0), "bold": odd, "italic": F.when(high | (i < 8), second).otherwise(False), "underline": high & (F.shiftright(i, 2) % 2 == 1)}
    )


def style_of(rows: DataFrame, bases: DataFrame, defaults: DataFrame, key: str, base: str, attributes: str) -> DataFrame:
    """Rows (key, style_id) with font_size, bold and italic: the document's style, else the default; ids out of range have style 0.

    ``bases`` has a row for each document with styles of its own, as ``font_table`` takes them. That row is joined, and not its
    13 styles: the style asked for is worked out behind the join.
    """
    names = ("font_size", "bold", "italic")
    put = F.when(F.col("style_id").between(0, ALL_STYLES - 1), F.col("style_id")).otherwise(0)
    mine = bases.select(key, F.col(base).alias("_base"), F.col(attributes).alias("_attributes"), F.lit(True).alias("_own"))
    given = defaults.select(F.col("style_id").alias("_default"), *[F.col(c).alias(f"_d_{c}") for c in names])
    joined = rows.withColumn("_id", put).join(mine, key, "left").join(F.broadcast(given), F.col("_id") == F.col("_default"))
    own, has = font_style(F.col("_base"), F.col("_attributes"), F.col("_id")), F.col("_own") & (F.col("_id") < DOCUMENT_STYLES)
    return joined.select(*rows.columns, *[F.coalesce(F.when(has, own[c]), f"_d_{c}").alias(c) for c in names])


def block_spans(records: DataFrame, key: str) -> DataFrame:
    """Spans of text records (key, seq, base_offset, block_sizes, flags): span_idx, offset, style_id.

    Blocks without bytes, and blocks without a flag, give none. Offsets are in the document and don't wrap.
    """
    flags = F.col("flags")
    blocks = records.select(key, "seq", "base_offset", flags, F.posexplode("block_sizes").alias("block", "size")).where("size > 0 AND block < length(flags)")
    order = Window.partitionBy(key, "seq").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("offset", F.col("base_offset") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    flag = F.conv(F.hex(F.substring(flags, F.col("block") + 1, F.lit(1))), 16, 10).cast("int")
    index = F.row_number().over(Window.partitionBy(key).orderBy("seq", "block")) - 1
    return placed.select(key, index.alias("span_idx"), F.col("offset").cast("long").alias("offset"), block_style(flag).alias("style_id"))


def runs_of_spans(spans: DataFrame, totals: DataFrame, key: str, total: str, default_style: int = 0) -> DataFrame:
    """Runs that fill each text: run_idx, start, length, style_id.

    Text before the first span has the default style; of spans on one offset the last holds; spans past
    the end are left out, and so are runs without characters. ``totals`` has a row for each document.
    """
    known = spans.join(totals.select(key, F.col(total).alias("_total")), key)
    per_offset = known.where(F.col("offset") <= F.col("_total")).groupBy(key, "offset").agg(F.max_by("style_id", "span_idx").alias("style_id"), F.max("_total").alias("_total"))
    heads = totals.select(key, F.lit(0).cast("long").alias("offset"), F.lit(default_style).alias("style_id"), F.col(total).alias("_total"))
    starts = heads.join(per_offset.where("offset = 0").select(key), key, "left_anti").unionByName(per_offset)
    order = Window.partitionBy(key).orderBy("offset")
    lengths = starts.withColumn("length", (F.coalesce(F.lead("offset").over(order), F.col("_total")) - F.col("offset")).cast("long")).where("length > 0")
    return lengths.select(key, (F.row_number().over(order) - 1).alias("run_idx"), F.col("offset").alias("start"), "length", "style_id")


def runs_of_records(records: DataFrame, key: str, order: str, total: str, default_style: int = 0) -> DataFrame:
    """Runs of records (key, order, base_offset, size, block_sizes, flags, and the document's ``total``), as ``block_spans`` and ``runs_of_spans`` make them.

    A record's blocks are placed by an array fold, and the default style's span goes in front of a document's
    first record, so that all else is windows over the document. Blocks without bytes or without a flag give no span.
    """
    flags, sizes = F.col("flags"), F.coalesce("block_sizes", F.array().cast("array<int>"))
    n = F.coalesce(F.length(flags), F.lit(0))
    flag = lambda i: F.conv(F.hex(F.substring(flags, i + 1, F.lit(1))), 16, 10).cast("int")
    spans = F.transform(sizes, lambda size, i: F.struct(i.alias("block"), F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0))).alias("at"), size.alias("size"), flag(i).alias("flag")))
    styled = F.transform(F.filter(spans, lambda s: (s["size"] > 0) & (s["block"] < n)), lambda s: F.struct(s["block"].alias("block"), (F.col("base_offset") + s["at"]).alias("offset"), block_style(s["flag"]).alias("style_id")))
    begin = F.when(F.col("base_offset") == 0, F.array(F.struct(F.lit(-1).alias("block"), F.lit(0).cast("long").alias("offset"), F.lit(default_style).alias("style_id"))))
    listed = records.select(key, order, F.col(total).alias("_total"), F.inline(F.concat(F.coalesce(begin, F.array().cast("array<struct<block:int,offset:bigint,style_id:int>>")), styled)))
    w = Window.partitionBy(key).orderBy("offset", order, "block")
    # of spans on one offset the last has a length
    lengths = listed.where("offset <= _total").withColumn("length", (F.coalesce(F.lead("offset").over(w), F.col("_total")) - F.col("offset")).cast("long")).where("length > 0")
    return lengths.select(key, (F.row_number().over(w) - 1).alias("run_idx"), F.col("offset").alias("start"), "length", "style_id")


def coalesced(runs: DataFrame, keys: list[str], order: list[str], value: Column, *measures: Column) -> DataFrame:
    """Neighbouring rows of equal ``value`` as one: island, value and the aggregates asked for."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = runs.withColumn("value", value).withColumn("_new", F.when(F.col("value").eqNullSafe(F.lag("value").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    islands = changed.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return islands.groupBy(*keys, "island", "value").agg(*measures)


def run_texts(runs: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, run_idx, style_id and the text of each run. A document's runs go to its text as one array, so no text is copied for each of them."""
    listed = runs.groupBy(key).agg(F.collect_list(F.struct("run_idx", "start", "length", "style_id")).alias("_runs"))
    part = lambda r: F.struct(r["run_idx"].alias("run_idx"), r["style_id"].alias("style_id"), F.substring(F.col(text), (r["start"] + 1).cast("int"), r["length"].cast("int")).alias("text"))
    return texts.join(listed, key).select(key, F.inline(F.transform("_runs", part)))
