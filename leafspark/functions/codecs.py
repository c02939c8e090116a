"""Record codecs that Spark doesn't have: small pure functions, and Arrow functions over columns.

The Huffman codec is DEFLATE's dynamic block with another framing: bits come from 32-bit big-endian words,
low bit first, one set of trees serves all blocks of a record, and each block begins on a word. With the
bytes of every word turned round the bits are in DEFLATE's order, so a block is handed to zlib behind a
header that states the record's trees anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The order of code-length codes (RFC 1951), and limits of the record format.
LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
MOST_BLOCKS, BLOCK_BYTES, TEXT_START, FALLBACK_WORDS, READABLE = 32, 65_536, 36, 10, 30
SCORED_BYTES, LEAST_SCORED = 500, 50
#: The trees of a record end before this byte.
TREE_BYTES = 1024


class Bits:
    """Bits of a short byte string, low bit first, as one integer."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data, "little"), 8 * len(data), 0

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise EOFError
        out = (self.value >> self.at) & ((1 << n) - 1)
        self.at += n
        return out


def turned_words(data: bytes) -> bytes:
    """Whole 32-bit words with their bytes in reverse order."""
    return np.frombuffer(data[: len(data) // 4 * 4], dtype=">u4").astype("<u4").tobytes()


def canonical(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) of every symbol with a length, as RFC 1951 assigns them."""
    out, code = {}, 0
    for n in range(1, max(lengths, default=0) + 1):
        for symbol in (s for s, x in enumerate(lengths) if x == n):
            out[n, code] = symbol
            code += 1
        code <<= 1
    return out


def read_lengths(bits: Bits, codes: dict[tuple[int, int], int], count: int) -> list[int]:
    """A list of code lengths; a repeat never runs past the list's end."""
    out: list[int] = []
    # what each next seven bits begin with: codes are that long at most, as three bits state their lengths
    begins = {}
    for (n, code), symbol in codes.items():
        first = int(f"{code:0{n}b}"[::-1], 2)
        begins.update((first | rest << n, (symbol, n)) for rest in range(1 << (7 - n)))
    while len(out) < count:
        symbol, n = begins.get(bits.value >> bits.at & 0x7F, (0, 0))
        if not n:
            raise ValueError("no such code")
        bits.take(n)
        if symbol < 16:
            out.append(symbol)
        elif symbol == 16:
            out += [out[-1] if out else 0] * (bits.take(2) + 3)
        else:
            out += [0] * (bits.take(3) + 3 if symbol == 17 else bits.take(7) + 11)
    return out[:count]


@lru_cache(maxsize=256)
def block_header(literals: tuple[int, ...], distances: tuple[int, ...]) -> tuple[int, int]:
    """DEFLATE bits, a whole number of bytes, after which a block of these trees can follow; value and size."""
    value = size = 0

    def put(x: int, n: int) -> None:
        nonlocal value, size
        value |= x << size
        size += n

    total = 3 + 14 + 3 * 19 + 4 * (len(literals) + len(distances))
    while (total + size) % 8:  # empty blocks of fixed trees, ten bits each
        put(0b010, 10)
    put(0b101, 3)
    put(len(literals) - 257, 5)
    put(len(distances) - 1, 5)
    put(15, 4)
    for symbol in LENGTH_ORDER:
        put(4 if symbol < 16 else 0, 3)
    for n in (*literals, *distances):
        put(int(f"{n:04b}"[::-1], 2), 4)
    return value, size


def inflate_words(data: bytes) -> tuple[bytes, list[int]] | None:
    """Text and block sizes of a record's trees and blocks; None if the trees or the first block can't be read."""
    stream = turned_words(data)
    bits = Bits(stream[:TREE_BYTES])
    try:
        n_literals, n_distances, n_lengths = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
        if n_literals > 286 or n_distances > 30:
            return None
        of_lengths = [0] * 19
        for symbol in LENGTH_ORDER[:n_lengths]:
            of_lengths[symbol] = bits.take(3)
        codes = canonical(of_lengths)
        literals, distances = read_lengths(bits, codes, n_literals), read_lengths(bits, codes, n_distances)
    except (EOFError, ValueError):
        return None
    value, size = block_header(tuple(literals), tuple(distances))
    head, view = value.to_bytes(size // 8, "little"), memoryview(stream)
    at, blocks = -(-bits.at // 32) * 4, []
    while at < len(stream) and len(blocks) < MOST_BLOCKS:
        block, used = inflate_block(head, view[at:])
        if not 0 < len(block) <= BLOCK_BYTES:
            break
        blocks.append(block)
        at += max(4, -(-used // 4) * 4)
    return (b"".join(blocks), [len(b) for b in blocks]) if blocks else None


def inflate_block(head: bytes, view: memoryview, step: int = 8192) -> tuple[bytes, int]:
    """A block behind its header, and the bytes it takes; nothing if it is broken or longer than a block may be."""
    inflater = zlib.decompressobj(-15)
    parts, size, at = [], 0, 0
    try:
        parts.append(inflater.decompress(head))
        while at < len(view) and not inflater.eof and size <= BLOCK_BYTES:
            parts.append(inflater.decompress(view[at : at + step], BLOCK_BYTES + 1 - size))
            size += len(parts[-1])
            at = min(at + step, len(view))
    except zlib.error:
        return b"", 0
    return b"".join(parts), at - len(inflater.unused_data)


def readable_score(data: bytes) -> int:
    """How much the first bytes look like text; -1 if there are few."""
    head = np.frombuffer(data[:SCORED_BYTES], dtype=np.uint8)
    n = len(head)
    if n < LEAST_SCORED:
        return -1
    count = lambda flags: int(flags.sum())
    return count((head >= 0x20) & (head <= 0x7E)) * 100 // n + count(head == 0x20) * 10 // n + count((head == 10) | (head == 13)) * 20 // n


def whole_utf8(data: bytes) -> bool:
    """Whether bytes are UTF-8 text from begin to end, and no fewer than can be scored."""
    if len(data) < LEAST_SCORED:
        return False
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def decode_text_record(data: bytes) -> tuple[bytes, list[int]] | None:
    """Trees and blocks at byte 36 (0 if the record is shorter); else at the first of eleven words that gives readable text.

    The score counts ASCII alone, so where no word gives such text, the first holds that gives whole UTF-8.
    """
    first = inflate_words(data[TEXT_START:] if len(data) > TEXT_START else data)
    if first:
        return first
    found = (inflate_words(data[4 * word :]) for word in range(min(len(data) // 4 - 2, FALLBACK_WORDS) + 1))
    other = None
    for text in filter(None, found):
        if readable_score(text[0]) > READABLE:
            return text
        if other is None and whole_utf8(text[0]):
            other = text
    return other


def copy_back(out: bytearray, distance: int, length: int) -> None:
    """Append bytes that stand ``distance`` back; they may overlap what they add."""
    for _ in range(length):
        out.append(out[-distance] if 0 < distance <= len(out) else 0)


def token_starts(steps: np.ndarray) -> np.ndarray:
    """Places reached from 0 when each place is followed by the one ``steps`` further on."""
    n = len(steps)
    # where one token, two, four, ... further on lead; in a long stream only each 32nd token is gone to one by one
    after = [np.append(np.minimum(np.arange(n) + steps, n), n)]
    for _ in range(5 if n > 2000 else 0):
        after.append(after[-1][after[-1]])
    far, out, at = memoryview(after.pop()), [], 0
    while at < n:
        out.append(at)
        at = far[at]
    found = np.array(out, dtype=np.int64)
    for jump in reversed(after):
        found = np.stack([found, jump[found]], axis=1).ravel()
    return found[: np.searchsorted(found, n)]


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the runs of ``sizes`` from ``begins`` on."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)


def palmdoc_tokens(raw: np.ndarray, wide: bool) -> tuple[np.ndarray, ...]:
    """Place of each token of a stream, whether it is a raw run and whether a pair, its two-byte value, and the bytes it gives."""
    is_run = (raw >= 1) & (raw <= 8)
    is_pair = (raw >= 0x80) & (wide | (raw < 0xC0))
    at = token_starts(1 + np.where(is_run, raw, 0) + is_pair)
    if is_pair[at[-1]] and at[-1] + 1 == len(raw):  # a pair of one byte ends the stream
        at = at[:-1]
    token, run, pair = raw[at], is_run[at], is_pair[at]
    second = raw[np.minimum(at + 1, len(raw) - 1)]
    both = ((token << 8) | second) & 0x3FFF
    copied = np.where(token < 0xC0, 3, (token >> 2 & 7) + 3) if wide else (both & 7) + 3
    size = np.where(pair, copied, np.where(run, np.minimum(token, len(raw) - at - 1), 1 + (token >= 0xC0)))
    return at, run, pair, both, size


def palmdoc_size(data: bytes, wide: bool = False) -> int:
    """Bytes that a stream expands to, told from its tokens alone."""
    return int(palmdoc_tokens(np.frombuffer(data, dtype=np.uint8).astype(np.int64), wide)[4].sum()) if data else 0


def expand_palmdoc(data: bytes, wide: bool = False) -> bytes:
    """PalmDoc's LZ77. With ``wide``, the variant in which pairs have 14 bits of distance and from 0xC0 on a length."""
    if not data:
        return b""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    at, run, pair, both, size = palmdoc_tokens(raw, wide)
    token = raw[at]
    joined = (token >= 0xC0) & ~pair
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    single = ~(run | pair)
    out[begin[single]] = np.where(joined[single], 0x20, token[single])
    out[begin[joined] + 1] = token[joined] & 0x7F
    out[ranges(begin[run], size[run])] = raw[ranges(at[run] + 1, size[run])]
    held = bytearray(out.tobytes())
    back = np.minimum(both, begin) if wide else both >> 3
    for o, d, n in zip(begin[pair].tolist(), back[pair].tolist(), size[pair].tolist(), strict=True):
        if d >= n and d <= o:
            held[o : o + n] = held[o - d : o - d + n]
        elif 0 < d <= o:
            held[o : o + n] = (held[o - d : o] * (n // d + 1))[:n]
        elif d:  # from before the text: zeros, and behind them what the pair itself has put
            for i in range(o, o + n):
                held[i] = held[i - d] if d <= i else 0
    return bytes(held)


def matches(data: np.ndarray, window: int, least: int, most: int, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Length (0: none) and distance, for each place, of what stands at the latest place before that has the same ``least`` bytes.

    Matches are ``most`` bytes long at most, ``window`` back at most and, with ``begin``, not from before the
    place's begin, and end before the next one's.
    """
    n = len(data) - least + 1
    length, back = np.zeros(len(data), dtype=np.int64), np.zeros(len(data), dtype=np.int64)
    if n <= 0:
        return length, back
    key = np.zeros(n, dtype=np.int64)
    for j in range(least):
        key = key << 8 | data[j : j + n]
    # key and place as one number, which sorts faster than places by key
    both = np.sort(key << 31 | np.arange(n))
    order = both & 0x7FFFFFFF
    same = both[1:] >> 31 == both[:-1] >> 31
    at, before = order[1:][same], order[:-1][same]
    ok = at - before <= window
    if begin is not None:
        ok &= (before >= begin[at]) & (begin[at + least - 1] == begin[at])
    at, before = at[ok], before[ok]
    back[at], length[at] = at - before, least
    for j in range(least, most):
        more = at + j < len(data)
        at, before = at[more], before[more]
        more = data[at + j] == data[before + j]
        if begin is not None:
            more &= begin[at + j] == begin[at]
        at, before = at[more], before[more]
        if not len(at):
            break
        length[at] = j + 1
    return length, back


def pack_palmdoc(data: bytes) -> bytes:
    """A PalmDoc stream of ``data``: pairs where ten bytes or fewer stand up to 2047 back, joined spaces, raw runs."""
    if not data:
        return b""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    n = len(raw)
    length, back = matches(raw, 2047, 3, 10)
    after = np.append(raw[1:], 0)
    spaced = (raw == 0x20) & (after >= 0x40) & (after < 0x80)
    rough = (raw >= 0x80) | ((raw >= 1) & (raw <= 8))
    smooth = np.append(np.flatnonzero(~rough), n)
    run = np.minimum(smooth[np.searchsorted(smooth, np.arange(n))] - np.arange(n), 8)
    at = token_starts(np.where(length > 0, length, np.where(spaced, 2, np.where(rough, run, 1))))
    length, back, byte = length[at], back[at], raw[at]
    pair = length > 0
    joined, rough = spaced[at] & ~pair, rough[at] & ~pair
    size = np.where(pair, 2, np.where(rough, 1 + run[at], 1))
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    out[begin] = np.where(pair, 0x80 | back >> 5, np.where(joined, after[at] | 0x80, np.where(rough, run[at], byte)))
    out[begin[pair] + 1] = (back[pair] << 3 | length[pair] - 3) & 0xFF
    out[ranges(begin[rough] + 1, run[at[rough]])] = raw[ranges(at[rough], run[at[rough]])]
    return out.tobytes()


def packed(values: np.ndarray, sizes: np.ndarray, begins: np.ndarray, total: int) -> bytes:
    """Values of ``sizes`` bits put at bits ``begins``, low bit first, in a record's words."""
    bits = np.zeros(-(-total // 32) * 32, dtype=np.uint8)
    for j in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > j)
        bits[begins[own] + j] = values[own] >> j & 1
    return turned_words(np.packbits(bits, bitorder="little").tobytes())


def reach(count: int, per_step: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value and number of extra bits of DEFLATE's codes: ``per_step`` codes to each further bit (RFC 1951, 3.2.5)."""
    extra = np.maximum(np.arange(count) // per_step - 1, 0)
    return first + np.concatenate([[0], np.cumsum(1 << extra)[:-1]]), extra


@lru_cache(maxsize=1)
def fixed_codes() -> tuple:
    """The packer's trees as a record begins with them, codes and sizes of literals and of distances, and what length and distance codes reach."""
    literals, distances = [8] * 226 + [9] * 60, [4] * 2 + [5] * 28
    head = [(286 - 257, 5), (30 - 1, 5), (15, 4), *((4 if s < 16 else 0, 3) for s in LENGTH_ORDER)]
    head += [(int(f"{n:04b}"[::-1], 2), 4) for n in (*literals, *distances)]
    value, size = (np.array(x, dtype=np.int64) for x in zip(*head, strict=True))

    def coded(lengths: list[int]) -> np.ndarray:
        turned = np.zeros(len(lengths), dtype=np.int64)
        for (n, code), s in canonical(lengths).items():
            turned[s] = int(f"{code:0{n}b}"[::-1], 2)
        return turned

    trees = packed(value, size, np.cumsum(size) - size, int(size.sum()))
    return trees, coded(literals), np.array(literals), coded(distances), np.array(distances), *reach(28, 4, 3), *reach(30, 2, 1)


def pack_words(data: bytes, block: int = 4096) -> bytes:
    """A record's trees and blocks that inflate_words reads: codes of fixed lengths, matches inside of blocks."""
    trees, literal_code, literal_size, distance_code, distance_size, least_length, length_extra, least_distance, distance_extra = fixed_codes()
    out = [trees]
    if not data:
        return trees

    raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    begin = np.arange(len(raw)) // block * block
    length, back = matches(raw, 32_768, 4, 32, begin)
    at = token_starts(np.where(length > 0, length, 1))
    length, back, byte = length[at], back[at], raw[at]
    pair = length > 0
    long = np.where(pair, np.searchsorted(least_length, length, side="right") - 1, 0)
    far = np.where(pair, np.searchsorted(least_distance, back, side="right") - 1, 0)
    symbol = np.where(pair, 257 + long, byte)
    # of each token: code, extra bits of its length, code of its distance, extra bits of that; behind a block's last its end
    values = np.stack([literal_code[symbol], length - least_length[long], distance_code[far], back - least_distance[far], np.full(len(at), literal_code[256])], axis=1)
    ends = np.append(begin[at[1:]] != begin[at[:-1]], True)
    sizes = np.stack([literal_size[symbol], *(np.where(pair, x, 0) for x in (length_extra[long], distance_size[far], distance_extra[far])), np.where(ends, literal_size[256], 0)], axis=1)
    values, sizes = values.ravel(), sizes.ravel()
    places = np.cumsum(sizes) - sizes
    # every block begins on a word
    cut = np.flatnonzero(ends) * 5 + 5
    closed = np.cumsum(sizes)[cut - 1]
    spare = np.cumsum(-np.diff(closed, prepend=0) % 32)
    places = places + np.repeat(np.concatenate([[0], spare[:-1]]), np.diff(cut, prepend=0))
    out.append(packed(values, sizes, places, int(closed[-1] + spare[-1])))
    return b"".join(out)


def looks_utf8(data: bytes) -> bool:
    """Whether multi-byte sequences outnumber broken ones in the first 500 bytes, and there are any."""
    head, good, bad, i = data[:SCORED_BYTES], 0, 0, 0
    if head.isascii():
        return False
    try:
        head.decode()  # whole sequences only
        return True
    except UnicodeDecodeError:
        pass
    while i < len(head):
        b = head[i]
        need = 0 if b < 0x80 or b >= 0xF8 else 1 if 0xC0 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if b >= 0xF0 else -1
        tail = head[i + 1 : i + 1 + max(need, 0)]
        if need > 0 and len(tail) == need and all(c & 0xC0 == 0x80 for c in tail):
            good, i = good + 1, i + need
        elif need:
            bad += 1
        i += 1
    return 0 < good and bad < good


def lenient_utf8(data: bytes) -> str:
    """UTF-8 whose continuation bytes aren't verified; a lead byte that can't lead becomes ``?``."""
    try:
        return data.decode()  # valid text is the same either way
    except UnicodeDecodeError:
        pass
    out, i = bytearray(), 0
    while i < len(data):
        b = data[i]
        n = 1 if b < 0x80 else 2 if 0xC0 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF8 else 0
        if n == 0 or i + n > len(data):
            n, code = 1, 0x3F
        else:
            code = b if n == 1 else b & (0x7F >> n)
            for c in data[i + 1 : i + n]:
                code = code << 6 | c & 0x3F
        units = [code] if code <= 0xFFFF else [0xD800 + (code - 0x10000 >> 10) & 0xFFFF, 0xDC00 + (code & 0x3FF)]
        for u in units:
            out += u.to_bytes(2, "little")
        i += n
    return out.decode("utf-16-le", "replace")


def toc_entries(data: bytes, at: int) -> list[dict]:
    """Entries from byte ``at`` on: offset, title length, one byte skipped, Latin-1 title. Empty titles are passed over."""
    out = []
    while len(data) - at >= 5:
        size = data[at + 2]
        end = at + 4 + size
        if end > len(data):
            break
        if size:
            out.append({"title": data[at + 4 : end].decode("latin-1"), "target_offset": int.from_bytes(data[at : at + 2], "big")})
        at = end
    return out


def page_deltas(data: bytes) -> list[dict]:
    """Deltas of a page tree's offsets, in order, with the number of the sub-tree each is of."""
    out: list[dict] = []
    number = lambda i, n: int.from_bytes(data[i : i + n], "big") if 0 <= i and i + n <= len(data) else None
    if len(data) < 8 or not 0 < data[0] < len(data):
        return out
    head = data[0]
    table = head + data[head]
    for sub in range(min((number(head + 3, 1) or 0) + 1, 2)):
        base, listed = number(table + 4 * sub, 2), number(table + 4 * sub + 2, 2)
        if not base or not listed or base + 8 > len(data):
            continue
        kind, count = data[base + 2] & 3, number(base + 6, 2)
        at, more, width = base + data[base], base + 16, 1 if kind < 2 else 2
        for i in range(count):
            x = number(at, width)
            if x is None:
                break
            at += width
            top = 1 << (8 * width - 1)
            delta = x + 1
            if kind & 1:
                delta = (x & top - 1) + 1
                if x & top:
                    extra = number(more, width)
                    more += width
                    delta += (extra or 0) * top
            out.append({"sub": sub, "i": i, "delta": delta})
    return out


TOC_TYPE = T.ArrayType(T.StructType().add("title", T.StringType()).add("target_offset", T.IntegerType()))
DELTA_TYPE = T.ArrayType(T.StructType().add("sub", T.IntegerType()).add("i", T.IntegerType()).add("delta", T.IntegerType()))


#: Bytes of values that an Arrow function holds as Python objects: results are handed on when so many have been read.
HELD_BYTES = 1 << 20


def handed_on(columns: tuple[pa.Array, ...], work: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """Results of ``work`` on the rows of a batch's columns, in arrays of some HELD_BYTES read; a batch may hold 64 times as many."""
    held, size = [], 0
    for row in zip(*columns, strict=True):
        values = [x.as_py() for x in row]
        held.append(work(*values))
        size += 64 + sum(len(x) for x in values if isinstance(x, bytes))
        if size >= HELD_BYTES:
            yield pa.array(held, kind)
            held, size = [], 0
    if held:
        yield pa.array(held, kind)


def _mapped(kind: T.DataType, work):
    """An Arrow function of a binary column, in which few values are Python objects at once; null stays null."""
    arrow = to_arrow_type(kind)
    known = lambda x: None if x is None else work(x)

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in parts:
            yield from handed_on((s,), known, arrow)

    return run


#: Codecs of records: bytes as they are, PalmDoc's pairs, and blocks behind trees.
PLAIN, PAIRS, BLOCKS = 0, 1, 2


DECODED_TYPE = T.StructType().add("data", T.BinaryType()).add("block_sizes", T.ArrayType(T.IntegerType()))


@F.arrow_udf(DECODED_TYPE)
def decode_udf(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A record's bytes and block sizes by the codec that it is tagged with; nulls where it can't be decoded or has no codec."""

    def decoded(codec: int | None, data: bytes | None) -> dict:
        none = {"data": None, "block_sizes": None}
        if data is None:
            return none
        if codec == PAIRS:
            return none | {"data": expand_palmdoc(data)}
        found = decode_text_record(data) if codec == BLOCKS else None
        return none if found is None else {"data": found[0], "block_sizes": found[1]}

    for columns in parts:
        yield from handed_on(columns, decoded, to_arrow_type(DECODED_TYPE))


@F.arrow_udf(TOC_TYPE)
def toc_udf(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Contents entries of each record from its own begin on."""
    for columns in parts:
        yield from handed_on(columns, lambda x, at: None if x is None else toc_entries(x, at), to_arrow_type(TOC_TYPE))


expand_udf = _mapped(T.BinaryType(), expand_palmdoc)
expand_wide_udf = _mapped(T.BinaryType(), lambda x: expand_palmdoc(x, wide=True))
palmdoc_size_udf = _mapped(T.LongType(), palmdoc_size)
pack_palmdoc_udf = _mapped(T.BinaryType(), pack_palmdoc)
pack_words_udf = _mapped(T.BinaryType(), pack_words)
inflate_udf = _mapped(T.BinaryType(), lambda x: (inflate_words(x) or (b"", []))[0])
looks_utf8_udf = _mapped(T.BooleanType(), looks_utf8)
text_record_udf = _mapped(T.BinaryType(), lambda x: (decode_text_record(x) or (b"", []))[0])
lenient_utf8_udf = _mapped(T.StringType(), lenient_utf8)
page_deltas_udf = _mapped(DELTA_TYPE, page_deltas)
