"""Small decisions as expressions: formats, styles, font sizes, labels and screen zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafspark.functions.binary import has_flag

#: Document formats, and the flags of a document.
FORMAT_NONE, FORMAT_V1, FORMAT_V2, FORMAT_V3, FORMAT_PALMDOC, FORMAT_TEXT = 0, 1, 2, 3, 5, 6
FACE_DEFAULT, FACE_SERIF, FACE_SANS, FACE_MONO = 0, 1, 2, 3
PAST_END = 5


def document_format(kind: Column, version: Column) -> Column:
    """Format of a container by its type and the first number of record 0 (null: unreadable)."""
    by_version = F.when(version.isNull() | (version >= 3), FORMAT_V3).when(version == 2, FORMAT_V2).otherwise(FORMAT_V1)
    return F.when(kind == "SDoc", by_version).when(kind == "ToGo", FORMAT_V2).when(kind == "TEXt", FORMAT_PALMDOC).otherwise(FORMAT_NONE)


def block_style(flag: Column) -> Column:
    """Style of a block by its flag byte: two of bold, italic and the third bit are style 3."""
    bold, italic, third = (has_flag(flag, b).cast("int") for b in (0x10, 0x20, 0x40))
    return F.when(bold + italic + third >= 2, 3).otherwise(bold + 2 * italic + 3 * third)


def document_flags(version: Column, images: Column, toc: Column, encrypted: Column) -> Column:
    """Version 4 and later 1, images 2, table of contents 4, encryption 8."""
    bit = lambda c, n: F.when(c, n).otherwise(0)
    return bit(version >= 4, 1) + bit(images, 2) + bit(toc, 4) + bit(encrypted, 8)


def font_size(raw: Column) -> Column:
    """8 to 32 as it is, 33 to 127 halved, else 20."""
    return F.when(raw.between(8, 32), raw).when(raw.between(33, 127), F.floor(raw / 2)).otherwise(20).cast("int")


def typeface(style_id: Column) -> Column:
    return F.when(style_id.between(0, 3), FACE_SERIF).when(style_id.between(4, 7), FACE_SANS).when(style_id == 12, FACE_MONO).otherwise(FACE_DEFAULT)


def screen_action(x: Column, width: Column) -> Column:
    """What a tap does: the outer thirds of the screen turn the page, the middle follows a link."""
    return F.when(x < width / 3, "previous").when(x > width * 2 / 3, "next").otherwise("link")


def page_label(page: Column, total: Column) -> Column:
    """Label of a page (0-based), with the number of pages if it is known."""
    return F.when(total > 0, F.format_string("Página %d/%d", page + 1, total)).otherwise(F.format_string("Página %d", page + 1))


def on_page(page: Column, count: Column) -> Column:
    return (page >= 0) & (page < count)


def line_height(size: Column, raised: Column) -> Column:
    """Height of a line of a style; super- and subscript take three quarters."""
    return F.floor(F.when(raised, (size + 4) * 3 / 4).otherwise(size + 4)).cast("int")


def baseline_shift(size: Column, superscript: Column, subscript: Column) -> Column:
    third = F.floor(size / 3).cast("int")
    return F.when(superscript, -third).when(subscript, third).otherwise(0)


def is_error(code: Column) -> Column:
    return code < 0
