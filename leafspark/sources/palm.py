"""Palm database containers: header, records, and what record 0 says of a document.

Everything here is expressions on the container's bytes; a container is one row, its records are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leafspark.functions.binary import from_integer, has_flag, i32, latin1, title_of, u8, u16, u32, until_nul
from leafspark.functions.rules import FORMAT_PALMDOC, FORMAT_V1, FORMAT_V2, FORMAT_V3, document_format
from leafspark.sources.files import diagnostics

#: Fixed values of the format: sizes, the record-0 magic, and the text encoding that means UTF-8.
HEADER_BYTES, ENTRY_BYTES = 78, 8
RECORD_0_MAGIC, RECORD_0_BYTES, UTF8_ENCODING = "isSilo", 128, 106
GROUPS, RANGES = 4, 18
SHORT_READ, CORRUPT, NO_RECORD = -2147024886, -2028929015, -2147483643
#: The compression code of a PalmDoc whose records are compressed.
PACKED = 2


def headers(files: DataFrame) -> DataFrame:
    """path and the header's fields; ``valid`` is false where the header is cut off or counts more records than fit."""
    c = F.col("content")
    count = u16(c, 76)
    return files.select(
        "path",
        until_nul(latin1(F.substring(c, 1, 32))).alias("name"),
        u16(c, 32).alias("attributes"),
        u16(c, 34).alias("version"),
        latin1(F.substring(c, 61, 4)).alias("type"),
        latin1(F.substring(c, 65, 4)).alias("creator"),
        count.alias("record_count"),
        F.coalesce(F.length(c) >= HEADER_BYTES + ENTRY_BYTES * count, F.lit(False)).alias("valid"),
        "content",
    )


def records(heads: DataFrame, *facts: str) -> DataFrame:
    """path, idx, offset, size, attr and data of every record of the valid headers, and the container's ``facts``.

    A record ends where the next one begins, the last at the end of the file. One whose extent is
    negative or passes the end has null data, and the others stay. Facts are fields of ``with_facts``, worked
    out once for each container before its records are listed.
    """
    c, entry = F.col("content"), entry_at
    listed = F.transform(
        F.sequence(F.lit(0), F.col("record_count") - 1),
        lambda i: F.struct(
            i.alias("idx"),
            u32(c, entry(i)).alias("offset"),
            F.coalesce(F.when(i + 1 < F.col("record_count"), u32(c, entry(i + 1))), F.length(c).cast("long")).alias("end"),
            u8(c, entry(i) + 4).alias("attr"),
        ),
    )
    known = (with_facts(heads) if facts else heads).where("valid AND record_count > 0")
    each = known.select("path", "content", *facts, F.explode(listed).alias("r"))
    return each.select("path", "r.idx", "r.offset", (F.col("r.end") - F.col("r.offset")).alias("size"), "r.attr", cut_out(c, F.col("r.offset"), F.col("r.end")).alias("data"), *facts)


def entry_at(i: Column) -> Column:
    return F.lit(HEADER_BYTES) + ENTRY_BYTES * i


def cut_out(content: Column, begin: Column, end: Column) -> Column:
    """Bytes of an extent; null if it is negative or passes the end."""
    return F.when((end >= begin) & (end <= F.length(content)), F.substring(content, (begin + 1).cast("int"), (end - begin).cast("int")))


def with_head(heads: DataFrame) -> DataFrame:
    """Headers with head, the bytes of record 0 (null if there is none), and format; they are cut from the content at hand.

    Head comes out of a generator of one row, behind which Catalyst doesn't put its whole expression in each place where head is used.
    """
    c = F.col("content")
    end = F.when(F.col("record_count") > 1, u32(c, entry_at(F.lit(1)))).otherwise(F.length(c).cast("long"))
    head = F.when(F.col("valid") & (F.col("record_count") > 0), cut_out(c, u32(c, entry_at(F.lit(0))), end))
    return heads.select("*", F.inline(F.array(F.struct(head.alias("head"))))).withColumn("format", document_format(F.col("type"), u16(F.col("head"), 0)))


def record_at(heads: DataFrame, index: Column, *keep: str) -> DataFrame:
    """One record of each container, by number: path, idx, data, code and message, and the columns ``keep``.

    Only its own extent is cut out, no list of records is made. Every container has a row: NO_RECORD where it has no
    record of that number, SHORT_READ where the record passes the end, CORRUPT where it can't be opened; data is null there.
    """
    c = F.col("content")
    listed = heads.withColumn("idx", index.cast("int"))
    i, count = F.col("idx"), F.col("record_count")
    there = F.col("valid") & (i >= 0) & (i < count)
    end = F.when(i + 1 < count, u32(c, entry_at(i + 1))).otherwise(F.length(c).cast("long"))
    found = listed.withColumn("data", F.when(there, cut_out(c, u32(c, entry_at(i)), end)))
    code = F.when(~F.col("valid") | (count == 0), CORRUPT).when(~F.coalesce(there, F.lit(False)), NO_RECORD).when(F.col("data").isNull(), SHORT_READ).otherwise(0)
    number = i.cast("string")
    message = F.when(F.col("code") == CORRUPT, "header cut off").when(F.col("code") == NO_RECORD, F.concat(F.lit("no record "), number)).when(F.col("code") == SHORT_READ, F.concat(F.lit("record "), number, F.lit(" is cut off")))
    return found.withColumn("code", code).select("path", "idx", "data", "code", message.alias("message"), *keep)


def record_0(recs: DataFrame) -> DataFrame:
    return recs.where("idx = 0").select("path", F.col("data").alias("head"))


def identified(heads: DataFrame) -> DataFrame:
    """Headers with their format; the first number of record 0 decides among versions of one type."""
    return with_head(heads).drop("content", "head")


def with_facts(heads: DataFrame) -> DataFrame:
    """Headers with what record 0 says of their document, in the layout of its format: null where it isn't of that format or can't be read."""
    h, version = F.col("head"), F.col("format")
    current, early, doc = current_fields(h), early_fields(h), palmdoc_fields(h)
    of = lambda kind, value: F.when(kind, value)
    now, then, plain = (version == FORMAT_V3) & current["valid"], version.isin(FORMAT_V1, FORMAT_V2), version == FORMAT_PALMDOC
    facts = {
        "block_unit": of(now, current["block_unit"]),
        "charset": F.coalesce(of(now, current["charset"]), F.lit("LATIN-1")),
        "toc_start": of(now, current["record_starts"][1]),
        "toc_count": of(now, current["record_counts"][1]),
        "trees": of(now, F.slice(current["record_starts"], 3, 2)),
        "packed": F.when(then, early["compressed"]).when(plain, doc["compression"] == PACKED),
        "text_records": of(plain, doc["text_records"]),
        "title": F.coalesce(F.nullif(F.when(then, early["title"]).when(plain, doc["title"]), F.lit("")), F.col("name")),
    }
    return with_head(heads).withColumns(facts)


def _table(head: Column, at: Column, count: Column, keep: int) -> Column:
    """The first ``keep`` of ``count`` u16 numbers, zeros where there are fewer."""
    return F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.when(i < count, F.coalesce(u16(head, at + 2 * i), F.lit(0))).otherwise(0))


def current_fields(h: Column) -> dict[str, Column]:
    """Record 0 of the current format: header fields, and its group and range tables (zeros if cut off).

    ``valid`` needs 128 bytes and the magic. All range starts are read, so
    counts after more than 18 ranges come from where they are.
    """
    at = u16(h, 0)
    groups = F.coalesce(u16(h, at), F.lit(0))
    ranges_at = at + 2 + 2 * groups
    ranges = F.coalesce(u16(h, ranges_at), F.lit(0))
    whole = F.length(h) >= ranges_at + 2 + 4 * ranges
    flags = u16(h, 36)
    known = lambda n: F.when(whole, n).otherwise(0)
    return {
        "valid": F.coalesce((F.length(h) >= RECORD_0_BYTES) & (latin1(F.substring(h, 7, 6)) == RECORD_0_MAGIC), F.lit(False)),
        "header_size": at,
        "doc_version": F.array(*[u8(h, i) for i in (2, 3, 4)]),
        "layout": u16(h, 12),
        "column_widths": F.array(*[u8(h, i) for i in range(14, 20)]),
        "text_size": i32(h, 20),
        "block_unit": u16(h, 24),
        "page_count": u16(h, 30),
        "title_font": u16(h, 32),
        "body_font": u16(h, 34),
        "charset": F.when(u16(h, 38) == UTF8_ENCODING, "UTF-8").otherwise("LATIN-1"),
        "raw_encoding": u16(h, 38),
        "crc": u32(h, 40),
        "font_attr1": u8(h, 52),
        "font_attr2": u8(h, 53),
        "last_page": u16(h, 56),
        "embedding": u16(h, 58),
        "compressed": (~has_flag(flags, 1)),
        "encrypted": has_flag(flags, 2),
        "has_toc": has_flag(flags, 4),
        "has_images": has_flag(flags, 8),
        "group_a": _table(h, at + 2, known(groups), GROUPS),
        "record_starts": _table(h, ranges_at + 2, known(ranges), RANGES),
        "record_counts": _table(h, ranges_at + 2 + 2 * ranges, known(ranges), RANGES),
    }


def current_layout(firsts: DataFrame) -> DataFrame:
    """path and ``current_fields`` of ``firsts`` (path, head)."""
    return firsts.select("path", *[c.alias(n) for n, c in current_fields(F.col("head")).items()])


def _short_string(head: Column, at: Column) -> Column:
    """A string after its length byte; null if it passes the end."""
    size = u8(head, at)
    return F.when(F.length(head) >= at + 1 + size, latin1(F.substring(head, at + 2, size)))


def early_fields(h: Column) -> dict[str, Column]:
    """Record 0 of versions 1 and 2: version, flags, title and author."""
    title, author = _short_string(h, F.lit(4)), _short_string(h, F.lit(5) + u8(h, F.lit(4)))
    return {
        "version": u16(h, 0),
        "compressed": ~has_flag(u16(h, 2), 0x8000),
        "encrypted": has_flag(u16(h, 2), 2),
        "has_toc": has_flag(u16(h, 2), 4),
        "title": until_nul(title),
        "author": until_nul(author),
    }


def palmdoc_fields(h: Column) -> dict[str, Column]:
    """Record 0 of a PalmDoc: compression, text length, record count and size, and a title if there is one."""
    return {
        "compression": u16(h, 0),
        "text_length": i32(h, 4),
        "text_records": u16(h, 8),
        "record_size": u16(h, 10),
        "title": F.when(F.length(h) > 16, until_nul(latin1(F.substring(h, 17, 64)))),
    }


def containers(parts: DataFrame, key: str, order: str, data: str, name: Column, kind: str, creator: str = "Leaf") -> DataFrame:
    """Containers written from rows: path (the key as a string) and content, with each key's rows as records in order.

    ``data`` is binary; a container holds at most 65 535 records. Its parts are put together by one
    aggregation on the key.
    """
    by = Window.partitionBy(key)
    before = by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(by)
    placed = parts.select(
        F.col(key).cast("string").alias("path"),
        F.col(order).alias("_order"),
        F.col(data).alias("_data"),
        name.alias("_name"),
        n.alias("_n"),
        (F.lit(HEADER_BYTES) + ENTRY_BYTES * n + F.coalesce(F.sum(F.length(data)).over(before), F.lit(0))).alias("_at"),
        (F.row_number().over(by.orderBy(order)) - 1).alias("_idx"),
    )
    entry = F.concat(from_integer(F.col("_at"), 4), from_integer(F.col("_idx"), 1), F.lit(bytes(3)))
    whole = placed.withColumn("_entry", entry).groupBy("path").agg(
        F.max("_name").alias("_name"), F.max("_n").alias("_n"), F.expr("listagg(_entry) WITHIN GROUP (ORDER BY _order)").alias("_entries"), F.expr("listagg(_data) WITHIN GROUP (ORDER BY _order)").alias("_bodies")
    )
    head = F.concat(F.expr("rpad(substring(encode(_name, 'ISO-8859-1'), 1, 31), 32, X'00')"), F.lit(bytes(28)), F.lit(kind.encode()), F.lit(creator.encode()), F.lit(bytes(8)), from_integer(F.col("_n"), 2))
    return whole.select("path", F.concat(head, "_entries", F.coalesce("_bodies", F.lit(b""))).alias("content"))


def open_failures(heads: DataFrame) -> DataFrame:
    """Rows for containers that can't be opened: cut off, empty, or of no known format. ``heads`` are identified."""
    code = F.when(~F.col("valid"), CORRUPT).when(F.col("record_count") == 0, CORRUPT).when(F.col("format") == 0, CORRUPT).otherwise(0)
    text = F.when(~F.col("valid"), "header cut off").when(F.col("record_count") == 0, "no records").otherwise("unknown format")
    return diagnostics(heads, "open", code, text)


def observed(heads: DataFrame, name: str = "opening") -> tuple[DataFrame, Observation]:
    """Headers that count themselves on their way through whatever plan is built on them, and where the counts are read when it has run.

    Counts: containers, and those that are cut off, empty or of no known format, as ``open_failures`` lists them, without a pass of their own.
    """
    seen = Observation(name)
    known = with_head(heads)
    empty, unknown = F.col("valid") & (F.col("record_count") == 0), F.col("valid") & (F.col("record_count") > 0) & (F.col("format") == 0)
    counted = known.observe(seen, F.count("*").alias("containers"), F.count_if(~F.col("valid")).alias("cut_off"), F.count_if(empty).alias("no_records"), F.count_if(unknown).alias("unknown_format"))
    return counted.select(*heads.columns), seen


def record_failures(recs: DataFrame) -> DataFrame:
    """Rows for records that couldn't be read: their extent is negative or passes the end of the file."""
    text = F.concat(F.lit("record "), F.col("idx").cast("string"), F.lit(" is cut off"))
    return diagnostics(recs.where(F.col("data").isNull()), "record", F.lit(SHORT_READ), text)


__all__ = ["CORRUPT", "FORMAT_PALMDOC", "FORMAT_V3", "NO_RECORD", "SHORT_READ", "containers", "current_layout", "headers", "identified", "observed", "open_failures", "record_0", "record_at", "record_failures", "records", "title_of", "with_facts"]
