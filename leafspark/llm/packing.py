"""Harmonic packing of tokenised documents into fixed-size sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of capacity // k tokens, and a
bin of that class takes exactly k of them. Documents are cut so that all pieces but a short rest hit
a class length exactly; rests fill the last class's bins one after the other. Every task fills its
own bins, so nothing is shuffled. Bins still open at the end of a task are cut at powers of two,
which need no padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from leafspark.llm.arrow_text import lower_ascii, run_hashes, sized_slices, utf8, words

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64())])


#: Marks that the tokenizer cuts off a word, and that it lowers to themselves.
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,!?;:*#%&$")] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Second bytes, after 0xC3, of the letters U+00C0 to U+00FF (0x97 and 0xB7 are signs).
_TRAIL = np.zeros(256, dtype=bool)
_TRAIL[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True


class PieceTable:
    """Token ids of known byte strings, found by their 64-bit hashes, which are held in order: some 12 bytes for each."""

    def __init__(self):
        self.index, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.begins = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")

    def find(self, keys: list[int]) -> np.ndarray:
        """Place of each key in the table, or -1."""
        asked = np.array(keys, dtype=np.uint64)
        if not len(self.index):
            return np.full(len(asked), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.index, asked), len(self.index) - 1)
        return np.where(self.index[at] == asked, self.place[at].astype(np.int64), -1)

    def add(self, keys: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        """Add keys that aren't there yet, each once."""
        new, known = np.array(keys, dtype=np.uint64), len(self.index)
        order = np.argsort(new)
        at = np.searchsorted(self.index, new[order])
        self.index, self.place = np.insert(self.index, at, new[order]), np.insert(self.place, at, known + order)
        begins = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, ids])
        self.counts = np.concatenate([self.counts, counts])
        self.begins = np.concatenate([self.begins, begins])

    def gather(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at the given places of the table, and the sums of their numbers from 0 on."""
        counts = self.counts[piece]
        sums = np.concatenate([[0], np.cumsum(counts)])
        return self.pool[np.repeat(self.begins[piece] - sums[:-1], counts) + np.arange(sums[-1])], sums


class WordTokenizer:
    """Ids of a tokenizer whose words, cut at white space, are coded independently.

    Every different word is coded once and kept in a table, up to ``most`` words. A new word of
    Latin-1 letters and then marks is cut into its lower-case stem and the marks, as the tokenizer
    does, so that few stems have to be coded; other words are coded whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.parts = PieceTable(), PieceTable()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _code(self, texts: list[str], stems: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids and their numbers. Stems end with an end-of-word token each, so many share a call."""
        pool, counts = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(texts), 1000):
            part = texts[at : at + 1000]
            if stems:
                (ids,) = self._ids([" ".join(part)])
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(part):
                    pool.append(ids)
                    counts.append(np.diff(ends, prepend=0))
                    continue
            each = self._ids(part)
            pool.extend(each)
            counts.append(np.array([len(x) for x in each], dtype=np.int64))
        return np.concatenate(pool), np.concatenate(counts)

    def _learn(self, keys: list[int], data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Add the words at the given bytes to the table."""
        lengths = stops - starts
        ends = np.cumsum(lengths)
        begins = ends - lengths
        own = data[np.repeat(starts - begins, lengths) + np.arange(ends[-1])]
        lead = np.zeros(len(own), dtype=bool)
        lead[:-1] = (own[:-1] == 0xC3) & _TRAIL[own[1:]]
        letter = _ASCII_LETTER[own] | lead
        letter[1:] |= lead[:-1]
        others = np.append(np.flatnonzero(~letter), len(own))
        cut = np.minimum(others[np.searchsorted(others, begins)], ends)
        marks = np.concatenate([[0], np.cumsum(_MARK[own])])
        plain = (cut > begins) & (marks[ends] - marks[cut] == ends - cut)
        lower = lower_ascii(own)
        trail = np.flatnonzero(lead) + 1
        lower[trail[own[trail] < 0x9F]] += 0x20  # 0x9F ends the sharp s, which has no capital here
        raw = own.tobytes()
        odd = np.flatnonzero(~plain)
        self.words.add([keys[i] for i in odd.tolist()], *self._code([raw[begins[i] : ends[i]].decode() for i in odd], stems=False))

        good = np.flatnonzero(plain)
        if not len(good):
            return
        runs = np.stack([begins[good], cut[good], cut[good], ends[good]], axis=1).reshape(-1, 2)
        full = np.flatnonzero(runs[:, 1] > runs[:, 0])
        which, hashes = pd.factorize(run_hashes(lower, runs[full, 0], runs[full, 1]))
        where = np.zeros(len(hashes), dtype=np.int64)
        where[which[::-1]] = full[::-1]
        parts = hashes.tolist()
        found = self.parts.find(parts)
        fresh = np.flatnonzero(found < 0)
        low = lower.tobytes()
        for stems in (True, False):
            mine = fresh[(where[fresh] % 2 == 0) == stems]
            self.parts.add([parts[i] for i in mine.tolist()], *self._code([low[a:b].decode() for a, b in runs[where[mine]].tolist()], stems))
        found[fresh] = self.parts.find([parts[i] for i in fresh.tolist()])
        ids, sums = self.parts.gather(found[which])
        upto = np.concatenate([[0], np.cumsum((runs[:, 1] > runs[:, 0]).reshape(-1, 2).sum(axis=1))])
        self.words.add([keys[i] for i in good.tolist()], ids, np.diff(sums[upto]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), and each text's limits in them."""
        data, ends = utf8(texts)
        starts, stops, first = words(data, ends)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(ends), dtype=np.int64)
        which, hashes = pd.factorize(run_hashes(data, starts, stops))
        if len(self.words.index) > self.most:
            self.words, self.parts = PieceTable(), PieceTable()
        keys = hashes.tolist()
        found = self.words.find(keys)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            where = np.zeros(len(keys), dtype=np.int64)
            where[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            at = where[fresh]
            new = [keys[i] for i in fresh.tolist()]
            self._learn(new, data, starts[at], stops[at])
            found[fresh] = self.words.find(new)
        ids, sums = self.words.gather(found[which])
        return ids, sums[first]


class HarmonicBins:
    """The open bins of one task; finished sequences become rows."""

    def __init__(self, capacity: int, classes: int, task: int):
        self.capacity, self.sizes = capacity, [capacity // k for k in range(1, classes + 1)]
        self.open: list[list[tuple]] = [[] for _ in range(classes + 1)]
        self.fill = 0  # of the last class's bin
        self.next_id = task << 36
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        at = 0
        for k, size in enumerate(self.sizes):
            while total - at >= size:
                held = self.open[k]
                held.append((doc_id, at, ids[4 * at : 4 * (at + size)], total))
                at += size
                if len(held) > k:
                    self._close(held)
                    held.clear()
        while at < total:
            part = min(total - at, self.capacity - self.fill)
            self.open[-1].append((doc_id, at, ids[4 * at : 4 * (at + part)], total))
            at, self.fill = at + part, self.fill + part
            if self.fill == self.capacity:
                self._close(self.open[-1])
                self.open[-1].clear()
                self.fill = 0

    def _close(self, pieces: list[tuple]) -> None:
        filled = sum(len(p[2]) for p in pieces) // 4
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, self.next_id, offset, filled))
            offset += len(ids) // 4
        self.next_id += 1

    def finish(self) -> None:
        """Cut what is open into sequences whose lengths are powers of two."""
        for held in self.open:
            rest = held[::-1]
            left = sum(len(p[2]) for p in held) // 4
            while left:
                want = need = 1 << (min(left, self.capacity).bit_length() - 1)
                taken = []
                while need:
                    doc_id, start, ids, total = rest.pop()
                    n = min(need, len(ids) // 4)
                    taken.append((doc_id, start, ids[: 4 * n], total))
                    if 4 * n < len(ids):
                        rest.append((doc_id, start + n, ids[4 * n :], total))
                    need -= n
                self._close(taken)
                left -= want
            held.clear()

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(_ARROW)
        out = pa.record_batch([pa.array(list(c), type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
        self.rows = []
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, classes: int = 16) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: its document, first token, length and ids (binary, little-endian
    unsigned 32-bit), the document's tokens with ``end_id``, the sequence and the place in it.
    Pieces of a sequence are gapless; a sequence's tokens are a power of two or are to be padded to
    ``capacity``. ``classes`` bounds the reciprocal classes (capacity // classes tokens at least).

    A null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed each;
    texts longer than ``capacity`` span sequences; other columns are ignored; an empty table gives
    no rows. Memory per task: one slice of texts and at most ``classes`` + 1 open bins.
    """
    if capacity < 1 or capacity & (capacity - 1) or not 1 <= classes <= capacity:
        raise ValueError("capacity must be a power of two, and classes between 1 and capacity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordTokenizer(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        bins = HarmonicBins(capacity, classes, TaskContext.get().partitionId())
        for batch in batches:
            for part in sized_slices(batch, "text", 250_000):
                ids, limits = coder.encode(part.column("text"))
                raw = ids.tobytes()
                limits = (4 * limits).tolist()
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), limits[:-1], limits[1:], strict=True):
                    bins.add(doc_id, raw[a:b] + end)
                if bins.rows:
                    yield bins.take()
        bins.finish()
        if bins.rows:
            yield bins.take()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
