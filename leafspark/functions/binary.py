"""Column functions on bytes and strings: big-endian integers, flags, slices, dumps and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What windows-1252 has at 0x80 to 0x9F (U+FFFD where nothing is defined).
WINDOWS_1252 = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
C1_CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0))
#: The code of a call that isn't supported, and the one of any other failure.
UNSUPPORTED, FAILED = -2147483643, -2147483648


def unsigned(data: Column, at: Column | int, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` (1 to 7) bytes at byte ``at``; null if the bytes aren't all there."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(size))
    return F.when((F.length(data) >= at + size) & (at >= 0), F.conv(F.hex(part), 16, 10).cast("long"))


def u8(data: Column, at: Column | int) -> Column:
    return unsigned(data, at, 1).cast("int")


def u16(data: Column, at: Column | int) -> Column:
    return unsigned(data, at, 2).cast("int")


def u32(data: Column, at: Column | int) -> Column:
    return unsigned(data, at, 4)


def i32(data: Column, at: Column | int) -> Column:
    """Big-endian signed 32-bit integer."""
    value = u32(data, at)
    return F.when(value >= 2**31, value - 2**32).otherwise(value).cast("int")


def from_integer(value: Column, size: int) -> Column:
    """``size`` big-endian bytes of an integer (the low bytes, two's complement)."""
    return F.unhex(F.right(F.concat(F.lit("0" * 2 * size), F.hex(value.cast("long"))), F.lit(2 * size)))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def byte_slice(data: Column, at: Column | int, size: Column | int) -> Column:
    """``size`` bytes or characters from ``at`` (0-based), fewer at the end; null from the end on."""
    at = F.lit(at) if isinstance(at, int) else at
    size = F.lit(size) if isinstance(size, int) else size
    return F.when((at >= 0) & (at < F.length(data)), F.substring(data, at + 1, F.greatest(size, F.lit(0))))


def hex_dump(data: Column, at: int, size: int) -> Column:
    """Upper-case hex of a byte range, a space between bytes."""
    return F.regexp_replace(F.hex(F.substring(data, at + 1, size)), "(..)(?!$)", "$1 ")


def until_nul(text: Column) -> Column:
    """The string up to its first NUL."""
    return F.substring_index(text, "\0", 1)


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def windows_1252(data: Column) -> Column:
    """Decode single bytes: Latin-1 but for the 32 places that windows-1252 fills."""
    return F.translate(latin1(data), C1_CONTROLS, WINDOWS_1252)


def title_of(name: Column) -> Column:
    """A container's name field as a title."""
    return until_nul(latin1(name))


def compare_code(a: Column, b: Column) -> Column:
    """0 if equal but for case, 2 if ``a`` is less, 3 if it is greater."""
    a, b = F.lower(a), F.lower(b)
    return F.when(a == b, 0).when(a < b, 2).otherwise(3)


def _order(a: Column, b: Column) -> Column:
    return F.when(a == b, 0).when(a < b, 2).otherwise(3)


def compare_signed(a: Column, b: Column) -> Column:
    """0, 2 or 3 for bytes that count from -128 to 127: those from 0x80 on come before all others."""
    low = "".join(map(chr, range(128)))
    above = "".join(chr(256 + c) for c in range(128))
    return _order(*(F.translate(latin1(x), low, above) for x in (a, b)))


def compare_ascii(a: Column, b: Column) -> Column:
    """0, 2 or 3 for bytes without regard to the case of A to Z; FAILED where a byte from 0x80 on is met before they differ or one ends."""
    upper = "".join(map(chr, range(65, 91)))
    a, b = (F.translate(latin1(x), upper, upper.lower()) for x in (a, b))
    plain = F.least(*(F.length(F.regexp_extract(x, r"^[\x00-\x7F]*", 0)) for x in (a, b)))
    before = _order(F.substring(a, F.lit(1), plain), F.substring(b, F.lit(1), plain))
    met = (plain < F.length(a)) & (plain < F.length(b))
    return F.when(before != 0, before).when(met, FAILED).otherwise(_order(F.length(a), F.length(b)))


def integers(values: Column, size: int) -> Column:
    """The big-endian bytes of an array of integers, one behind the other."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.hex(from_integer(v, size))), ""))


def utf16(text: Column) -> Column:
    """A string as big-endian 16-bit units."""
    return F.encode(text, "UTF-16BE")


def sought(size: Column, at: Column, offset: Column, mode: Column) -> Column:
    """Where a seek ends in ``size`` bytes, as a struct of position and code.

    Modes: 0 from the start, 1 from ``at``, 2 from the end. The position stays within 0 and ``size``; another
    mode leaves it at ``at`` and has the code UNSUPPORTED.
    """
    asked = F.when(mode == 0, offset).when(mode == 1, at + offset).when(mode == 2, size + offset)
    position = F.when(asked.isNull(), at).otherwise(F.greatest(F.lit(0), F.least(asked, size)))
    return F.struct(position.cast("long").alias("position"), F.when(mode.between(0, 2), 0).otherwise(UNSUPPORTED).alias("code"))


def parse_unsigned(text: Column) -> Column:
    """Digits after leading white space as a number: none give 0; over ten digits or 4294967295 give -1."""
    digits = F.regexp_extract(text, r"^[ \t\n-\r]*(\d*)", 1)
    value = F.when(digits == "", F.lit(0).cast("long")).otherwise(F.substring(digits, 1, 10).cast("long"))
    return F.when((F.length(digits) > 10) | (value > 4294967295), F.lit(-1).cast("long")).otherwise(value)


def storage_path(path: Column, root: str) -> Column:
    """A path with the conventional card prefix put under ``root``."""
    return F.regexp_replace(path, "^/sdcard/", root.rstrip("/") + "/")


def timestamp_parts(ts: Column) -> Column:
    """Year to second and hundredths of a second, as a struct."""
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.day(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts)}
    hundredths = F.floor(F.date_format(ts, "SSS").cast("int") / 10).cast("int")
    return F.struct(*[c.cast("int").alias(n) for n, c in parts.items()], hundredths.alias("centisecond"))


def readable_score(data: Column) -> Column:
    """How much the first 500 bytes look like text; -1 under 50 of them."""
    head = latin1(F.substring(data, 1, 500))
    n = F.length(head)
    count = lambda pattern: n - F.length(F.regexp_replace(head, pattern, ""))
    share = lambda pattern, weight: F.floor(count(pattern) * weight / n)
    return F.when(n < 50, F.lit(-1)).otherwise(share(r"[\x20-\x7E]", 100) + share(" ", 10) + share(r"[\n\r]", 20)).cast("int")
