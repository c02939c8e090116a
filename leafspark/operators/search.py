"""Finding text in documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_first(docs: DataFrame, query: str, start: Column | int = 0, text: str = "text", ignore_case: bool = False) -> DataFrame:
    """Rows that hold ``query`` at or after character ``start``, with the first match.

    Adds char_offset, byte_offset (UTF-8) and byte_length. A negative start is 0; an empty query matches
    nothing. The match is looked for in decoded text, so both offsets are right for any character.
    """
    whole, fixed = F.col(text), isinstance(start, int)
    at = F.lit(max(start, 0)) if fixed else F.greatest(start, F.lit(0))
    rest = whole if fixed and start <= 0 else F.substring(whole, at + 1, F.length(whole))
    if ignore_case:
        lower = F.lower(rest)
        # where lowering changes lengths, places in the lowered text aren't places in the text: there the part before the match is taken
        pattern = "(?ius)^(.*?)(" + re.escape(query) + ")"
        part = lambda k: F.regexp_extract(rest, pattern, k)
        by_pattern = F.when(part(2) != "", F.length(part(1)) + 1).otherwise(0)
        found = F.when(F.length(lower) == F.length(rest), F.locate(query.lower(), lower)).otherwise(by_pattern)
        size = F.when(F.length(lower) == F.length(rest), F.lit(len(query))).otherwise(F.length(part(2)))
    else:
        found, size = F.locate(query, rest), F.lit(len(query))
    hit = docs.withColumn("char_offset", F.when(found > 0, found + at - 1).cast("long")).where(F.col("char_offset").isNotNull() & F.lit(query != ""))
    begin = F.col("char_offset").cast("int")
    return hit.withColumns(
        {
            "byte_offset": F.octet_length(F.substring(whole, F.lit(1), begin)).cast("long"),
            "byte_length": F.octet_length(F.substring(whole, begin + 1, size)).cast("long"),
        }
    )


def search_start(scope: Column, page_start: Column) -> Column:
    """Start of a search: scope 1 is from the page shown, any other the whole document."""
    return F.when(scope == 1, page_start).otherwise(0)
