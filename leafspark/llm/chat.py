"""Conversations rendered by a template, with marks of what a model is to learn, and read back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.chat_template import compile_template, unescape

CONTROLS = ("###", "<says>", "</turn>")
TEMPLATE = (
    "{% for message in messages %}### {{ message.role | escape }}<says>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
PIECES = "conv_id long, piece long, text string, learned boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_PIECES = [("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("learned", pa.bool_())]
_READ = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
PIECE_CHARS = 65_536


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], fields: list[tuple], most: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), type=kind) for c, (_, kind) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch()
            held = []
    if held:
        yield batch()


def joined(pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, bool]]:
    """Neighbouring pieces under the same mark as one, up to about PIECE_CHARS."""
    held, size, mark = [], 0, False
    for text, learned in pieces:
        if held and (learned != mark or size >= PIECE_CHARS):
            yield "".join(held), mark
            held, size = [], 0
        mark = learned
        held.append(text)
        size += len(text)
    if held:
        yield "".join(held), mark


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """Render every conversation of ``turns`` (conv_id, turn, role, text) in order of turn.

    Returns the output as pieces: conv_id, piece (0 and on), text, learned (whether the template put it
    under generation); a conversation's output is its pieces' texts in order. Rows of a partition are
    sorted by conversation and piece.

    A null role or text is empty; equal turns go by role and text, and a null turn before all others;
    a row without a conv_id is a conversation of its own, of one turn; a conversation is read and written turn by turn, so its
    length isn't bounded by memory; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, controls)

        def pieces() -> Iterator[tuple]:
            for (conv_id, _), rows in groupby(_rows(batches), key=itemgetter(0, 1)):
                messages = ({"role": role, "text": text} for *_, role, text in rows)
                for i, (text, learned) in enumerate(joined(render(messages=messages))):
                    yield conv_id, i, text, learned

        return _batches(pieces(), _PIECES)

    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = clean.select("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"), "turn", "role", "text")
    return alone.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "turn", "role", "text").mapInArrow(run, PIECES)


def read_back(pieces: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """Parse what format_conversations rendered with TEMPLATE, straight from its partitions, and digest it.

    turns_sha256 is of role, newline, text, newline of each turn; loss_chars and loss_sha256 of what was
    learned, unescaped; formatted_chars of the output as it is.
    """
    # possessive, as nothing that a text may hold can begin what follows it; so a long turn leaves nothing to go back to
    part = r"((?:[^\\<#]++|\\\\|" + "|".join(r"\\" + re.escape(c) for c in controls) + r"|<(?!says>|/turn>)|#(?!##))*+)"
    turn = re.compile("### " + part + "<says>" + part + "</turn>\n", re.S)

    def conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows of one conversation after the other; each begins with piece 0."""
        n = 0

        def number(row: tuple) -> tuple:
            nonlocal n
            n += row[1] == 0
            return n, row[0]

        for (_, conv_id), own in groupby(rows, key=number):
            yield conv_id, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for conv_id, rows in conversations(_rows(batches)):
                turns, loss, n_turns, loss_chars, formatted, rest = sha256(), sha256(), 0, 0, 0, ""
                for _, _, text, learned in rows:
                    formatted += len(text)
                    if learned:
                        plain = unescape(controls, text)
                        loss_chars += len(plain)
                        loss.update(plain.encode())
                    rest += text
                    if "</turn>" not in text:
                        continue
                    at = 0
                    while m := turn.match(rest, at):
                        turns.update(f"{unescape(controls, m[1])}\n{unescape(controls, m[2])}\n".encode())
                        n_turns, at = n_turns + 1, m.end()
                    rest = rest[at:]
                if rest:
                    raise ValueError(f"conversation {conv_id}: can't read {rest[:80]!r}")
                yield conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted

        return _batches(digests(), _READ)

    return pieces.mapInArrow(run, READ)
