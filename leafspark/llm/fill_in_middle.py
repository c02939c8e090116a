"""Fill-in-the-middle: documents cut at two token boundaries and put in another order, by arithmetic on big integers.

A text is one integer per class of bytes, with a bit for each byte, the first byte's highest. Boundaries of
tokens are where a solid bit has no solid bit behind it, which is one shift and two boolean operations for the
whole text; their number is a count of bits, and the boundary of a given rank is found by halving the integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.llm.arrow_text import sized_slices

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_SOLID = bytes(48 if c == 0x20 or 0x09 <= c <= 0x0D else 49 for c in range(256))
_LEADS = bytes(48 if 0x80 <= c < 0xC0 else 49 for c in range(256))


def mask(data: bytes, classes: bytes) -> int:
    """An integer with a bit for each byte, the first one's highest: set where ``classes`` has the digit 1."""
    return int(data.translate(classes), 2) if data else 0


def boundaries(data: bytes) -> int:
    """The bits of the bytes that end a token: white space and the solid bytes behind it, or white space that ends the text."""
    solid = mask(data, _SOLID)
    ends = solid ^ (solid & (solid << 1))
    return ends | 1 if data and not solid & 1 else ends


def ranked(bits: int, width: int, rank: int) -> int:
    """Place, counted from the lowest, of the ``rank``-th set bit from the highest on (1 is the highest); halves are dropped until one bit is left."""
    low = 0
    while width > 1:
        half = width // 2
        high = bits >> half
        above = high.bit_count()
        if rank <= above:
            bits, low, width = high, low + half, width - half
        else:
            bits, rank, width = bits & ((1 << half) - 1), rank - above, half
    return low


def cut(data: bytes, first: int, second: int) -> tuple[int, int, int]:
    """Number of tokens, and the bytes before the cuts behind the lesser and the greater of two ranks, both taken modulo one more than that number."""
    ends = boundaries(data)
    n = ends.bit_count()
    a, b = sorted((first % (n + 1), second % (n + 1)))
    place = lambda rank: len(data) - ranked(ends, len(data), rank) if rank else 0
    return n, place(a), place(b)


def transformed(data: bytes, draws: tuple[int, int, int, int], rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, characters of prefix and middle (none if plain), and output of one text."""
    n, a, b = cut(data, draws[0], draws[1])
    if not data or draws[2] % 100 >= rate or any(m in data for m in _MARKS):
        return n, "plain", None, None, data
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    leads, size = mask(data, _LEADS), len(data)
    before = [(leads >> (size - x)).bit_count() for x in (a, b)]
    p, s, m = _MARKS
    form = "spm" if draws[3] % 100 < suffix_first else "psm"
    out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
    return n, form, before[0], before[1] - before[0], out


def draw(doc_id: Column, seed: int, nth: int) -> Column:
    """The ``nth`` (from 0) group of eight hex digits of the hash of seed and doc_id, as an integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1 + 8 * nth, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = 50, suffix_first: int = 80, seed: int = 42) -> DataFrame:
    """Cut each whole text at two random token boundaries and put it in another order, for ``rate`` percent of the documents.

    ``docs`` has doc_id and text. Returns doc_id, n (tokens), form (plain, psm or spm; ``suffix_first`` percent
    of those cut are spm), prefix_chars and middle_chars (null if plain) and output. What is drawn hangs on
    ``seed`` and doc_id alone, so a task that is run again gives the same rows. A text that holds one of the
    marks stays plain, so ``restore`` is exact.

    A null text counts as empty and stays plain, with no tokens; a null doc_id draws as an empty string;
    repeated rows get equal results; texts of any length are cut whole (an integer has an eighth of its text's
    bytes); other columns are ignored, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text"):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                draws = zip(*(part.column(f"h{k}").to_pylist() for k in range(1, 5)), strict=True)
                found = [transformed(t or b"", d, rate, suffix_first) for t, d in zip(texts, draws, strict=True)]
                n, form, prefix, middle, output = zip(*found, strict=True)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    drawn = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).withColumns({f"h{k}": draw(F.col("doc_id"), seed, k - 1) for k in range(1, 5)})
    return drawn.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` of ``fill_in_middle`` with restored: the text, rebuilt from output and form alone. A null output gives null."""
    out = F.col("output")
    size = len(PREFIX)
    found = rows.withColumn("_b", F.expr(f"locate(CASE WHEN form = 'spm' THEN '{PREFIX}' ELSE '{SUFFIX}' END, output, {size + 1})"))
    found = found.withColumn("_c", F.expr(f"locate('{MIDDLE}', output, _b + {size})"))
    head = F.substring(out, F.lit(size + 1), F.col("_b") - size - 1)
    body = F.substring(out, F.col("_b") + size, F.col("_c") - F.col("_b") - size)
    tail = F.substring(out, F.col("_c") + size, F.length(out))
    text = F.when(F.col("form") == "plain", out).when(F.col("form") == "spm", F.concat(body, tail, head)).otherwise(F.concat(head, tail, body))
    return found.withColumn("restored", text).drop("_b", "_c")
