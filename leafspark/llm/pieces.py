"""SentencePiece encoding and decoding by suffix-array matching.

A batch's different units (a run of spaces and what follows it up to the next space or line end, cut further
between two characters that no piece has side by side, so that no piece crosses units) are concatenated and
indexed by a suffix array. Every piece is searched in it; its range of suffixes gives its occurrences, which,
sorted by position, are the edges of all units' lattices. Relaxing takes the edges in the order of the model's
merges: of a unit's neighbouring symbols those whose joint edge has the best score become one, from the left,
until no edge joins neighbours. All units, of any length, advance together. Characters without a piece become
bytes. The ids equal those of the model's own library.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from leafspark.llm.arrow_text import run_hashes, sized_slices, utf8
from leafspark.llm.packing import PieceTable

SPACE = 0x2581
_GAP = -1
_LAST = 0x7FFFFFFE  # above every character
#: Characters of units that are indexed and relaxed at a time (a longer unit is alone).
INDEXED = 200_000
_MODELS: dict[str, tuple["PieceModel", PieceTable]] = {}


def pairs_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each pair of characters."""
    return (left.astype(np.int64) << 21) | right


def as_strings(points: np.ndarray) -> np.ndarray:
    """Rows of code points (_GAP is least) as byte strings that compare as they do."""
    return np.ascontiguousarray(points + 1, dtype=">u4").view(f"S{4 * points.shape[1]}").ravel()


@dataclass
class PieceModel:
    """A BPE vocabulary with byte fallback and no text normalisation but a space put before each text."""

    texts: np.ndarray  # pieces as code points in their order, _GAP after their ends
    lengths: np.ndarray
    ids: np.ndarray
    ranks: np.ndarray  # 0 is merged first
    byte_ids: np.ndarray
    forms: list[bytes]  # what each id decodes to
    breaks: bytes  # line ends and tabs that are in no piece
    beside: np.ndarray  # sorted pairs of characters that some piece has side by side
    least: np.ndarray  # the pieces as strings, least and greatest of what begins with them
    most: np.ndarray

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if model.is_byte(i)]
        if len(byte) != 256:
            raise ValueError("the model must have byte fallback")
        plain = sorted((i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))), key=names.__getitem__)
        if any(chr(SPACE) in names[i].lstrip(chr(SPACE)) for i in plain):
            raise ValueError("a piece has a space inside")
        lengths = np.array([len(names[i]) for i in plain])
        texts = np.full((len(plain), int(lengths.max())), _GAP, dtype=np.int32)
        for k, i in enumerate(plain):
            texts[k, : lengths[k]] = [ord(c) for c in names[i]]
        forms = [names[i].replace(chr(SPACE), " ").encode() for i in range(n)]
        for i in byte:
            forms[i] = bytes([int(names[i][3:5], 16)])
        for i in range(n):
            if model.is_control(i):
                forms[i] = b""
            elif model.is_unknown(i):
                forms[i] = " ⁇ ".encode()
        by_byte = np.zeros(256, dtype="<u4")
        for i in byte:
            by_byte[forms[i][0]] = i
        scores = np.array([model.get_score(i) for i in plain])
        used = {c for i in plain for c in names[i]}
        breaks = bytes(c for c in b"\n\t\r" if chr(c) not in used)
        beside = np.unique(pairs_of(texts[:, :-1], texts[:, 1:])[texts[:, 1:] != _GAP])
        ranks = np.unique(-scores, return_inverse=True)[1]
        return cls(texts, lengths, np.array(plain, dtype="<u4"), ranks, by_byte, forms, breaks, beside, as_strings(texts), as_strings(np.where(texts == _GAP, _LAST, texts)))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` characters at least, by doubling ranks that begin with three characters."""
    far = np.append(text.astype(np.int64) + 1, [0, 0])
    rank = np.unique((far[:-2] << 42) | (far[1:-1] << 21) | far[2:], return_inverse=True)[1].astype(np.int64)
    span = 3
    while span < depth:
        behind = np.zeros(len(rank), dtype=np.int64)
        behind[: max(len(rank) - span, 0)] = rank[span:] + 1
        rank = np.unique(rank * (len(rank) + 2) + behind, return_inverse=True)[1].astype(np.int64)
        span *= 2
    return np.argsort(rank)


def occurrences(text: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Begin and piece of every occurrence of every piece, sorted by begin and length."""
    width = model.texts.shape[1]
    order = suffix_array(text, width)
    padded = np.concatenate([text, np.full(width, _GAP, dtype=np.int32)])
    suffixes = as_strings(np.lib.stride_tricks.sliding_window_view(padded, width)[order])
    a = np.searchsorted(suffixes, model.least)
    b = np.searchsorted(suffixes, model.most, side="right")
    counts = b - a
    piece = np.repeat(np.arange(len(counts)), counts)
    begin = order[np.arange(int(counts.sum())) + np.repeat(a - np.cumsum(counts) + counts, counts)]
    sort = np.argsort(begin * (width + 1) + model.lengths[piece])
    return begin[sort], piece[sort]


def relax(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units at text[begins:ends], and each unit's number of ids."""
    width = model.texts.shape[1]
    at, piece = occurrences(text, model)
    edge = np.full((len(text) + 1, width + 1), -1, dtype=np.int32)
    edge[at, model.lengths[piece]] = piece
    none = np.int64(1) << 40
    ranks = np.append(model.ranks.astype(np.int64), none)

    def joint_rank(at: np.ndarray, size: np.ndarray, fits: np.ndarray) -> np.ndarray:
        return np.where(fits & (size <= width), ranks[edge[at, np.minimum(size, width)]], none)

    sizes = ends - begins
    unit = np.repeat(np.arange(len(begins)), sizes)
    start = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[unit]
    length = np.ones(len(start), dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(unit):
        key = np.append(joint_rank(start[:-1], length[:-1] + length[1:], unit[1:] == unit[:-1]), none)
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.minimum.reduceat(key, first)
        best = np.repeat(best, np.diff(np.append(first, len(unit))))
        settled = best >= none
        if settled.any():
            done.append((unit[settled], start[settled], length[settled]))
        # the best pairs of each unit; of pairs that share a symbol every other one, from the left
        place = np.flatnonzero((key == best) & ~settled)
        if not len(place):
            break
        run = np.flatnonzero(np.append(True, np.diff(place) > 1))
        place = place[(np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))) % 2 == 0]
        # pairs behind one whose merging offers an edge as good or better have to wait for that edge
        own = unit[place]
        joint = length[place] + length[place + 1]
        after = np.minimum(place + 2, len(unit) - 1)
        right = joint_rank(start[place], joint + length[after], (place + 2 < len(unit)) & (unit[after] == own))
        before = np.maximum(place - 1, 0)
        merged = np.append(False, np.diff(place) == 2)
        head = np.where(merged, np.maximum(place - 2, 0), before)
        left = joint_rank(start[head], start[place] - start[head] + joint, (place > 0) & (unit[before] == own))
        waits = np.minimum(left, right) <= best[place]
        if waits.any():
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            earlier = np.cumsum(waits) - waits
            place = place[earlier == np.repeat(earlier[heads], np.diff(np.append(heads, len(own))))]
        length[place] += length[place + 1]
        keep = ~settled
        keep[place + 1] = False
        unit, start, length = unit[keep], start[keep], length[keep]
    units, starts, lengths = (np.concatenate([d[k] for d in done] or [np.zeros(0, dtype=np.int64)]) for k in range(3))
    sort = np.argsort(starts, kind="stable")
    units, starts, lengths = units[sort], starts[sort], lengths[sort]
    found = edge[starts, lengths]
    ids = np.where(found >= 0, model.ids[np.maximum(found, 0)], 0).astype("<u4")
    n_ids = np.ones(len(ids), dtype=np.int64)
    bare = np.flatnonzero(found < 0)  # one character each
    if len(bare):
        coded = [chr(c).encode("utf-8", "surrogatepass") for c in text[starts[bare]]]
        n_ids[bare] = [len(c) for c in coded]
        out = np.repeat(ids, n_ids)
        out[np.repeat(found < 0, n_ids)] = model.byte_ids[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        ids = out
    return ids, np.bincount(units, weights=n_ids, minlength=len(begins)).astype(np.int64)


class PieceCoder:
    """Encodes and decodes batches; what a worker knows of units is kept from task to task, up to ``most`` units or ten times as many ids."""

    def __init__(self, path: str, most: int = 300_000):
        if path not in _MODELS:
            _MODELS[path] = (PieceModel.load(path), PieceTable())
        self.path, self.most = path, most
        self.model = _MODELS[path][0]
        self.ends_unit = np.zeros(256, dtype=bool)
        self.ends_unit[list(self.model.breaks)] = True
        forms = self.model.forms
        self.form_lengths = np.array([len(f) for f in forms])
        self.form_begins = np.cumsum(self.form_lengths) - self.form_lengths
        self.form_bytes = np.frombuffer(b"".join(forms), dtype=np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), and each text's limits in them."""
        texts = pa.array([t.replace(chr(SPACE), " ") if t else t for t in texts.to_pylist()], type=pa.large_string()) if b"\xe2\x96\x81" in utf8(texts)[0].tobytes() else texts
        data, ends = utf8(texts)
        sizes = np.diff(ends)
        held = sizes > 0
        data = np.insert(data, ends[:-1][held], 0x20)
        ends = np.concatenate([[0], np.cumsum(sizes + held)])
        if not len(data):
            return np.zeros(0, dtype="<u4"), ends
        blank, cut = data == 0x20, self.ends_unit[data]
        begins = np.ones(len(data), dtype=bool)
        begins[1:] = (blank[1:] & ~blank[:-1]) | cut[1:] | cut[:-1]
        begins[ends[:-1][held]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(data))
        which, hashes = pd.factorize(run_hashes(data, starts, stops))
        table = _MODELS[self.path][1]
        if len(table.index) > self.most or len(table.pool) > 10 * self.most:
            table = PieceTable()
            _MODELS[self.path] = (self.model, table)
        keys = hashes.tolist()
        found = table.find(keys)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            where = np.zeros(len(keys), dtype=np.int64)
            where[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            raw = data.tobytes()
            units = [raw[a:b].decode() for a, b in zip(starts[where[fresh]].tolist(), stops[where[fresh]].tolist(), strict=True)]
            new = [keys[i] for i in fresh.tolist()]
            table.add(new, *self._code(units))
            found[fresh] = table.find(new)
        ids, sums = table.gather(found[which])
        return ids, sums[np.searchsorted(starts, ends)]

    def _code(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, and each unit's number of ids."""
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        text = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
        text[text == 0x20] = SPACE
        pair = pairs_of(text[:-1], text[1:])
        beside = self.model.beside
        cut = np.append(True, beside[np.minimum(np.searchsorted(beside, pair), len(beside) - 1)] != pair)
        owner = np.repeat(np.arange(len(units)), lengths)
        cut[1:] |= owner[1:] != owner[:-1]
        begins = np.flatnonzero(cut)
        ends = np.append(begins[1:], len(text))
        ids, counts, at = [], [], 0
        while at < len(begins):
            upto = max(at + 1, int(np.searchsorted(ends, begins[at] + INDEXED, side="right")))
            a, b = begins[at:upto] - begins[at], ends[at:upto] - begins[at]
            # a gap behind each unit, so that no occurrence crosses units
            apart = np.full(int(b[-1]) + len(a), _GAP, dtype=np.int32)
            shift = np.arange(len(a))
            apart[np.arange(int(b[-1])) + np.repeat(shift, b - a)] = text[begins[at] : ends[upto - 1]]
            part, n = relax(apart, a + shift, b + shift, self.model)
            ids.append(part)
            counts.append(n)
            at = upto
        return np.concatenate(ids), np.bincount(owner[begins], weights=np.concatenate(counts), minlength=len(units)).astype(np.int64)

    def decode(self, ids: np.ndarray, limits: np.ndarray) -> list[str]:
        """The texts of runs of ids; broken byte sequences become U+FFFD."""
        counts = self.form_lengths[ids]
        sums = np.concatenate([[0], np.cumsum(counts)])
        raw = self.form_bytes[np.repeat(self.form_begins[ids] - sums[:-1], counts) + np.arange(sums[-1])].tobytes()
        at = sums[limits].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no ids; U+2581 in a text counts as a space; texts of any length are coded
    whole (a unit that can't be cut, such as a run of one character, takes some 200 bytes a character); a
    null doc_id is kept; repeated rows come back each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model_path)
        for batch in batches:
            for part in sized_slices(batch, "text", 1_000_000):
                ids, limits = coder.encode(part.column("text"))
                raw, at = ids.tobytes(), (4 * limits).tolist()
                yield pa.record_batch([part.column("doc_id"), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], type=pa.binary())], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """The same rows with the text that the ids stand for; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model_path)
        for batch in batches:
            for part in sized_slices(batch, "ids", 1_000_000):
                runs = [x or b"" for x in part.column("ids").to_pylist()]
                limits = np.concatenate([[0], np.cumsum([len(x) // 4 for x in runs])]).astype(np.int64)
                texts = coder.decode(np.frombuffer(b"".join(runs), dtype="<u4"), limits)
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(texts, type=pa.string())], names=["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
