"""From containers to documents: decoded records, text, styles, contents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.functions import codecs
from leafspark.functions.binary import title_of, windows_1252
from leafspark.functions.rules import FORMAT_PALMDOC, FORMAT_V1, FORMAT_V2, FORMAT_V3
from leafspark.operators import styles
from leafspark.operators.prefix import in_two_levels
from leafspark.sources import palm

TEXT_RECORD, TOC_SUBTYPE = b"\x04\x00", 8


def text_of(raw: Column, charset: Column) -> Column:
    """Decoded text: UTF-8 if it is declared or looks so, else windows-1252."""
    return F.when((charset == "UTF-8") | codecs.looks_utf8_udf(raw), codecs.lenient_utf8_udf(raw)).otherwise(windows_1252(raw))


def flag_bytes(data: Column, unit: Column) -> Column:
    """Style flags of a text record's blocks: after the unit's table, at byte 24 in a short record, else none."""
    n = F.when(unit > 0, unit).otherwise(8)
    usual = F.lit(4) + (n + 2) * 2
    at = F.when(usual + n <= F.length(data), usual).when(n + 24 <= F.length(data), 24)
    return F.when(at.isNull(), F.lit(b"")).otherwise(F.substring(data, at + 1, n))


def concatenated(parts: DataFrame, key: str, order: str, data: str = "data") -> DataFrame:
    """The parts of each key in order as one value (strings or bytes; nulls are nothing), with its bytes and number of parts."""
    joined = F.expr(f"listagg(`{data}`) WITHIN GROUP (ORDER BY `{order}`)")
    return parts.groupBy(key).agg(joined.alias("whole"), F.coalesce(F.sum(F.octet_length(data)), F.lit(0)).alias("bytes"), F.count(data).alias("parts"))


def base_offsets(parts: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """Start of each part in the concatenation; a key's parts are spread over many tasks."""
    placed = in_two_levels(parts, [key], [F.col(order)], before={"base_offset": size})
    return placed.withColumn("base_offset", F.col("base_offset").cast("long"))


def extents(parts: DataFrame, key: str, order: str, offset: str, end: Column) -> DataFrame:
    """Size of each part: up to the next one's offset, the last up to ``end``; a key's parts are spread over many tasks."""
    placed = in_two_levels(parts, [key], [F.col(order)], following={"_next": F.col(offset)})
    return placed.withColumn("size", (F.coalesce("_next", end) - F.col(offset)).cast("long")).drop("_next")


def estimated_size(records: DataFrame, key: str, size: str, declared: str) -> DataFrame:
    """Declared text size, or twice the records' bytes where the header says 0."""
    return records.groupBy(key).agg(F.max(declared).alias("_d"), F.sum(size).alias("_s")).select(key, F.when(F.col("_d") > 0, F.col("_d")).otherwise(2 * F.col("_s")).cast("long").alias("text_size"))


def text_records(heads: DataFrame, *facts: str) -> DataFrame:
    """Records from 1 on with data decoded (null: no text), block_sizes and flags, and ``facts`` of their documents.

    A record is tagged with the codec that its document's format asks for, and one Arrow function decodes
    all formats. Record 0 is there as well, without data, so that every document has a row.
    """
    own = ("format", "block_unit", "packed", "text_records")
    recs = palm.records(heads, *own, *[f for f in facts if f not in own])
    text = F.col("idx") > 0
    current = text & F.col("block_unit").isNotNull() & (F.substring("data", 1, 2) == F.lit(TEXT_RECORD))
    early = text & F.col("format").isin(FORMAT_V1, FORMAT_V2)
    doc = text & (F.col("format") == FORMAT_PALMDOC) & (F.col("idx") <= F.col("text_records"))
    codec = F.when(current, codecs.BLOCKS).when((early | doc) & F.col("packed"), codecs.PAIRS).when(early | doc, codecs.PLAIN)
    tagged = recs.where("format > 0").withColumns({"codec": codec, "flags": F.when(current, flag_bytes(F.col("data"), F.col("block_unit")))})
    packed = F.when(F.col("codec") != codecs.PLAIN, F.col("data"))
    found = tagged.withColumn("d", codecs.decode_udf(F.col("codec"), packed))
    data = F.when(F.col("codec") == codecs.PLAIN, F.col("data")).otherwise(F.col("d.data"))
    return found.select("path", "idx", F.when(F.length(data) > 0, data).alias("data"), "d.block_sizes", "flags", *facts)


def record_text(heads: DataFrame) -> DataFrame:
    """Decoded records: path, idx, data, block_sizes, flags, base_offset."""
    before = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)  # a container's records are one file's
    return text_records(heads).where("data IS NOT NULL").withColumn("base_offset", F.coalesce(F.sum(F.length("data")).over(before), F.lit(0)).cast("long"))


def documents(heads: DataFrame) -> DataFrame:
    """A row for each container of a known format that has records: path, format, title, charset, raw, text and its sizes.

    All text records are decoded. Bytes are concatenated before they are decoded, as a character may
    stand on both sides of a record's end. The containers are read once, and there is one shuffle.
    """
    parts = text_records(heads, "format", "title", "charset")
    same = [F.max(c).alias(c) for c in ("format", "title", "charset")]  # each document's rows agree in them
    whole = parts.groupBy("path").agg(*same, F.coalesce(F.expr("listagg(data) WITHIN GROUP (ORDER BY idx)"), F.lit(b"")).alias("raw"))
    text = whole.select("path", "format", "title", "charset", "raw", text_of(F.col("raw"), F.col("charset")).alias("text"))
    return text.withColumns({"text_bytes": F.length("raw").cast("long"), "text_chars": F.length("text").cast("long")})


def plain_text_documents(recs: DataFrame) -> DataFrame:
    """Containers taken as plain text: every record from 0 on, concatenated."""
    return concatenated(recs.where("data IS NOT NULL"), "path", "idx").select("path", F.col("whole").alias("raw"))


def contents(heads: DataFrame) -> DataFrame:
    """Tables of contents: path, entry_idx, title, target_offset.

    From the contents records; documents without entries there have those of the range that record 0 names.
    Both are read in one pass, and a window over the document says which of them hold.
    """
    recs = palm.records(heads, "block_unit", "toc_start", "toc_count").where("block_unit IS NOT NULL AND data IS NOT NULL")
    typed = (F.substring("data", 1, 2) == F.lit(bytes((4, TOC_SUBTYPE)))) & (F.length("data") >= 6)
    ranged = (F.col("toc_start") > 0) & (F.col("idx") >= F.col("toc_start")) & (F.col("idx") < F.col("toc_start") + F.col("toc_count"))
    begins = F.array_compact(F.array(F.when(typed, 2), F.when(ranged, 0)))
    read = recs.select("path", "idx", "data", F.explode(begins).alias("begin"))
    listed = read.select("path", "idx", "begin", F.posexplode(codecs.toc_udf("data", "begin")).alias("i", "e"))
    best = listed.withColumn("best", F.max("begin").over(Window.partitionBy("path"))).where("begin = best")
    index = F.row_number().over(Window.partitionBy("path").orderBy("idx", "i")) - 1
    return best.select("path", index.alias("entry_idx"), "e.title", F.col("e.target_offset").cast("long").alias("target_offset"))


def page_offsets(heads: DataFrame) -> DataFrame:
    """Page starts in stored order: path, page_idx, start; each sub-tree's deltas are summed from 0."""
    recs = palm.records(heads, "trees")
    trees = F.filter(F.sequence(F.lit(0), F.lit(1)), lambda t: F.element_at("trees", t + 1) == F.col("idx"))
    named = recs.where("idx > 0 AND array_contains(trees, idx)").select("path", F.explode(trees).alias("tree"), "data")
    deltas = named.select("path", "tree", F.explode(codecs.page_deltas_udf("data")).alias("d")).select("path", "tree", "d.sub", "d.i", "d.delta")
    # partitioned by path alone, so that sums and numbers share one shuffle
    order = Window.partitionBy("path").orderBy("tree", "sub", "i")
    upto = F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0))
    summed = deltas.withColumns({"upto": upto, "n": F.row_number().over(order)})
    before = F.coalesce(F.max(F.when(F.col("i") == 0, F.col("upto") - F.col("delta"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return summed.select("path", (F.col("n") - 1).alias("page_idx"), (F.col("upto") - before).cast("long").alias("start"))


def paging(offsets: DataFrame) -> DataFrame:
    """Starts fit for paging: distinct, in order, with a page from offset 0."""
    starts = offsets.select("path", "start").unionByName(offsets.select("path", F.lit(0).cast("long").alias("start"))).distinct()
    return starts.withColumn("page_idx", F.row_number().over(Window.partitionBy("path").orderBy("start")) - 1)


def text_runs(heads: DataFrame) -> DataFrame:
    """Runs of one style: path, run_idx, start, length, style_id, by the flags of the text records' blocks (byte offsets).

    Records, spans and runs are windows over the document, which share one shuffle by path.
    """
    w = Window.partitionBy("path")
    order = w.orderBy("idx")
    parts = text_records(heads).where("data IS NOT NULL").select("path", "idx", F.length("data").alias("size"), "block_sizes", "flags")
    based = parts.withColumns({
        "base_offset": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
        "total": F.sum("size").over(w),
    })
    return styles.runs_of_records(based, "path", "idx", "total")


def open_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder's containers: headers, records, documents, contents, page_offsets, text_runs and diagnostics.

    Each is a plan of its own that reads the containers once (diagnostics: twice).
    """
    from leafspark.sources.files import read_files

    heads = palm.headers(read_files(spark, [folder]))
    recs, known = palm.records(heads), palm.identified(heads)
    return {
        "headers": known, "records": recs, "documents": documents(heads), "contents": contents(heads), "page_offsets": page_offsets(heads), "text_runs": text_runs(heads),
        "diagnostics": palm.open_failures(known).unionByName(palm.record_failures(recs)),
    }


__all__ = ["base_offsets", "concatenated", "contents", "documents", "estimated_size", "extents", "flag_bytes", "open_folder", "page_offsets", "paging", "plain_text_documents", "record_text", "text_of", "text_records", "text_runs", "title_of"]
