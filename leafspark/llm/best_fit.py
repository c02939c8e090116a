"""Best-fit packing planned on a histogram of lengths.

Every task tokenises its documents and numbers them within their lengths. The plan is made from the counts of
the lengths alone: best fit, longest first, places all documents of one length in whole groups of equal bins, so
that it has a few thousand lines however many documents there are. A document finds its line by its rank within
its length.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.llm.arrow_text import SPACE, run_hashes, sized_slices, utf8, words
from leafspark.llm.packing import PieceTable
from leafspark.llm.scratch import saved

#: Classes of bytes for the tokenizer's first cut: white space, letters, digits, other marks, and what is left to the tokenizer.
BLANK, LETTER, DIGIT, OTHER, HARD = range(5)
#: White space beyond ASCII's, and separators near it: a text with one of them is left to the tokenizer whole.
ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: So many rows of first ranks are broadcast, of some 30 bytes each; more are joined by a shuffle.
MOST_BASES = 500_000


def _classes() -> np.ndarray:
    out = np.full(256, HARD, dtype=np.uint8)
    out[33:127] = OTHER
    out[48:58] = DIGIT
    out[[*range(65, 91), *range(97, 123)]] = LETTER
    out[SPACE] = BLANK
    out[[ord("'"), ord("|")]] = HARD  # contractions, and strings of special tokens
    return out


_CLASS = _classes()
#: First bytes of characters among which white space is.
_ODD = np.zeros(256, dtype=bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_TRAIL = np.zeros(256, dtype=bool)
_TRAIL[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True


def first_cut(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces begin that a byte-level tokenizer codes independently, and each byte's class; pieces may be longer than its own.

    A piece is a run of letters, digits or other marks, with a space before it if there is one; of white space
    before a word all but the last character is one piece. Words (between white space) with apostrophes, bars or
    characters beyond Latin letters are one piece with the white space before them.
    """
    kind = _CLASS[data]
    if len(data) > 1:
        lead = np.flatnonzero((data[:-1] == 0xC3) & _TRAIL[data[1:]])
        kind[lead] = kind[lead + 1] = LETTER
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[ends[:-1]] = True
    begins[1:-1] |= kind[1:] != kind[:-1]
    starts, stops, first = words(data, ends)
    # a word's unit reaches from the word before it (or its row's begin)
    unit = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    own = first[:-1][np.diff(first) > 0]
    unit[own] = ends[:-1][np.diff(first) > 0]
    gap = starts > unit
    last = starts[gap] - 1  # the white space right before a word
    begins[last] = True
    spaced = data[last] == 0x20
    begins[starts[gap][spaced]] = False
    hard = np.concatenate([[0], np.cumsum(kind == HARD)])
    rough = np.flatnonzero(hard[stops] > hard[starts])
    if len(rough):
        lengths = stops[rough] - unit[rough]
        inside = np.arange(int(lengths.sum())) + np.repeat(unit[rough] - np.cumsum(lengths) + lengths, lengths)
        begins[inside] = False
        begins[unit[rough]] = True
    return np.flatnonzero(begins[:-1]), kind


class ByteTokenizer:
    """Ids of a byte-level tokenizer. Every different piece of ``first_cut`` is coded once and kept, up to ``most`` of them."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.pieces = most, PieceTable()
        self.most_id = max(self.tokenizer.get_vocab().values())
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in each], dtype=np.int64)
        return np.fromiter(chain.from_iterable(each), dtype="<u4", count=int(counts.sum())), counts

    def _joined(self, texts: list[str], together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """As ``_coded``, for pieces without white space but for a space in front: many in one text, with a line end behind each, which is one token."""
        line = self.line_end
        pool, counts = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        parts = [texts[at : at + together] for at in range(0, len(texts), together)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(["\n".join(p) + "\n" for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.flatnonzero(ids == line)
            if len(ends) != len(part):
                own = self._coded(part)
            else:
                own = ids[ids != line], np.diff(ends, prepend=-1) - 1
            pool.append(own[0])
            counts.append(own[1])
        return np.concatenate(pool), np.concatenate(counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), and each text's limits in them."""
        data, ends = utf8(texts)
        odd = [r for r in np.unique(np.searchsorted(ends, np.flatnonzero(_ODD[data]), side="right") - 1).tolist() if ODD_BLANK.search(data[ends[r] : ends[r + 1]].tobytes().decode())]
        starts, kind = first_cut(data, ends) if len(data) else (np.zeros(0, dtype=np.int64), data)
        if odd:  # such a text is one piece
            row = np.searchsorted(ends, starts, side="right") - 1
            starts = starts[~np.isin(row, odd) | np.isin(starts, ends[:-1][odd])]
        stops = np.append(starts[1:], len(data)) if len(starts) else starts
        which, hashes = pd.factorize(run_hashes(data, starts, stops))
        if len(self.pieces.index) > self.most:
            self.pieces = PieceTable()
        keys = hashes.tolist()
        found = self.pieces.find(keys)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            where = np.zeros(len(keys), dtype=np.int64)
            where[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            at, raw = where[fresh], data.tobytes()
            rough = np.concatenate([[0], np.cumsum((kind == HARD) | (kind == BLANK))])
            first, last = starts[at], stops[at]
            plain = (rough[last] == rough[first + 1]) & ((kind[first] < OTHER + 1) & (kind[first] != BLANK) | (data[first] == 0x20) & (last > first + 1))
            for own, code in ((plain, self._joined), (~plain, self._coded)):
                which_new = fresh[own]
                self.pieces.add([keys[i] for i in which_new.tolist()], *code([raw[a:b].decode() for a, b in zip(first[own].tolist(), last[own].tolist(), strict=True)]))
            new = [keys[i] for i in fresh.tolist()]
            found[fresh] = self.pieces.find(new)
        ids, sums = self.pieces.gather(found[which])
        return ids, sums[np.searchsorted(starts, ends)]


@lru_cache(maxsize=1)
def coder_of(path: str) -> ByteTokenizer:
    """One tokenizer for all tasks that a worker process runs one after the other: what it has coded once stays known."""
    return ByteTokenizer(path, most=600_000)


def planned(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, of so many documents of each length into as many bins as they need.

    A line is (length, first rank, bins, documents of the length in a bin, first bin, offset): the document of rank
    r goes to bin ``first bin + (r - first rank) // documents`` at ``offset + length * ((r - first rank) % documents)``.
    Bins are kept in groups of neighbours with the same room, so a length splits two groups at most.
    """
    lines: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room: (first bin, bins)
    sizes: list[int] = []  # rooms there are, in order
    made = 0

    def put(size: int, group: tuple[int, int]) -> None:
        if size and group[1]:
            if size not in room:
                room[size] = []
                sizes.insert(bisect_left(sizes, size), size)
            room[size].append(group)

    for length in sorted((k for k, v in counts.items() if v and k > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):  # the tightest room: the next of its documents would go there again
                size = sizes[at]
                begin, bins = room[size].pop()
                if not room[size]:
                    del room[size], sizes[at]
            else:
                size, begin, bins = capacity, made, -(-left // (capacity // length))
                made += bins
            each = size // length
            whole = min(bins, left // each)
            rest = min(left - whole * each, each) if whole < bins else 0
            offset = capacity - size
            if whole:
                lines.append((length, rank, whole, each, begin, offset))
                put(size - each * length, (begin, whole))
            if rest:
                lines.append((length, rank + whole * each, 1, rest, begin + whole, offset))
                put(size - rest * length, (begin + whole, 1))
            untouched = bins - whole - (1 if rest else 0)
            put(size, (begin + bins - untouched, untouched))
            left -= whole * each + rest
            rank += whole * each + rest
    return lines


class Plan:
    """The plan's lines as arrays, by length and first rank."""

    def __init__(self, lines: list[tuple[int, int, int, int, int, int]]):
        held = np.array(sorted(lines), dtype=np.int64).reshape(-1, 6)
        self.length, self.rank, _, self.each, self.bin, self.offset = held.T

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of documents by their length and rank within it."""
        wide = max(int(self.rank.max(initial=0)), int(rank.max(initial=0))) + 1
        line = np.searchsorted(self.length * wide + self.rank, length * wide + rank, side="right") - 1
        nth = rank - self.rank[line]
        return self.bin[line] + nth // self.each[line], self.offset[line] + length * (nth % self.each[line])


def id_type(*ids: int) -> np.dtype:
    return np.dtype("<u2" if max(ids) < 1 << 16 else "<u4")


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, ids (binary, little-endian, unsigned, of 16 bits if all ids fit, else 32), tokens, rest (tokens modulo capacity), task, rank and whole.

    Ids end with ``end_id``. ``rank`` counts the task's documents of one rest from 0 on, and ``whole`` the full
    sequences of those before; read them only from a written table, whose tasks have all been committed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = coder_of(tokenizer), TaskContext.get().partitionId()
        kind = id_type(coder.most_id, end_id)
        end, seen, whole = np.array([end_id], dtype=kind).tobytes(), np.zeros(capacity, dtype=np.int64), 0
        for batch in batches:
            for part in sized_slices(batch, "text", 1_000_000):
                ids, limits = coder.encode(part.column("text"))
                raw, tokens, size = ids.astype(kind).tobytes(), np.diff(limits) + 1, kind.itemsize
                rest = tokens % capacity
                rank = seen[rest] + pd.Series(rest).groupby(rest).cumcount().to_numpy()
                seen += np.bincount(rest, minlength=capacity)
                full = tokens // capacity
                before = whole + np.cumsum(full) - full
                whole += int(full.sum())
                own = [raw[size * a : size * b] + end for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
                numbers = [pa.array(x) for x in (tokens, rest, np.full(len(own), task), rank, before)]
                yield pa.record_batch([part.column("doc_id"), pa.array(own, pa.binary()), *numbers], names=["doc_id", "ids", "tokens", "rest", "task", "rank", "whole"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, ids binary, tokens long, rest long, task long, rank long, whole long")


def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text) into few sequences of at most ``capacity`` tokens, cutting only longer documents.

    Returns a row per piece: doc_id, piece (from 0), start, length, ids (binary, little-endian unsigned 32-bit),
    sequence_id and offset (place in the sequence, whose pieces are gapless). Of a longer document the first piece takes what whole sequences leave over, and
    is planned like a document of that length; each other piece is a sequence. Planned sequences have even ids,
    whole ones odd ids.

    A null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed each; other
    columns are ignored; an empty table gives no rows. Tokens are written once to the shared folder. To the driver comes
    one count for each length, and the plan that goes to all tasks has a few lines for each; first ranks (one for each task and
    length) are broadcast up to MOST_BASES rows and joined by a shuffle beyond.
    """
    spark = docs.sparkSession
    held = saved(tokenised(docs, tokenizer, end_id, capacity), "best-fit-tokens")
    counted = saved(held.groupBy("task", "rest").agg(F.count("*").alias("n")), "best-fit-counts")
    totals = {r["rest"]: r["n"] for r in counted.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(Plan(planned({k: n for k, n in totals.items() if k}, capacity)))
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("task", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = held.join(F.broadcast(bases) if counted.count() <= MOST_BASES else bases, ["task", "rest"])
    return ranked.select("doc_id", "ids", "tokens", "rest", "task", "rank", "whole", "base").mapInArrow(_placed(plan, capacity), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def _placed(plan: Broadcast, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of tokenised documents at their planned places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "ids", 2_000_000):
                tokens, rest, task, rank, whole, base = (part.column(c).to_numpy() for c in ("tokens", "rest", "task", "rank", "whole", "base"))
                n = tokens // capacity + (rest > 0)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                led = rest[row] > 0
                short = led & (piece == 0)
                length = np.where(short, rest[row], capacity)
                start = np.where(led & (piece > 0), rest[row] + capacity * (piece - 1), capacity * piece)
                sequence, offset = 2 * ((task[row] << 36) + whole[row] + piece - led) + 1, np.zeros(len(row), dtype=np.int64)
                at = np.flatnonzero(short)
                if len(at):
                    found, offset[at] = plan.value.slots(length[at], rank[row[at]] + base[row[at]])
                    sequence[at] = 2 * found
                raw = part.column("ids").to_pylist()
                size = len(raw[0]) // int(tokens[0])
                ids = np.frombuffer(b"".join(raw), dtype=f"<u{size}").astype("<u4").tobytes()
                begin = 4 * ((np.cumsum(tokens) - tokens)[row] + start)
                own = [ids[a:b] for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                columns = [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(own, pa.binary()), pa.array(sequence), pa.array(offset)]
                yield pa.record_batch([part.column("doc_id").take(pa.array(row)), *columns], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return run
