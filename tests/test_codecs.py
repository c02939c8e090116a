"""Record codecs: round trips and hand-made streams."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from leafspark.functions import codecs

SMALL = st.binary(max_size=3000)


@settings(max_examples=60, deadline=None)
@given(SMALL)
def test_palmdoc_round_trip(data):
    assert codecs.expand_palmdoc(codecs.pack_palmdoc(data)) == data


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 700))
def test_words_round_trip(data, block):
    out = codecs.inflate_words(codecs.pack_words(data, max(block, len(data) // 32 + 1)))
    assert out is not None and out[0] == data and sum(out[1]) == len(data)


def test_palmdoc_tokens():
    assert codecs.expand_palmdoc(b"\x03abcd") == b"abcd"
    assert codecs.expand_palmdoc(b"a\x00b") == b"a\x00b"  # a NUL cuts nothing
    assert codecs.expand_palmdoc(b"a\xe1") == b"a a"
    assert codecs.expand_palmdoc(b"ab" + (0x8000 | 2 << 3 | 7).to_bytes(2, "big")) == b"ab" + b"ab" * 5
    assert codecs.expand_palmdoc(b"a\x80") == b"a"  # a pair cut off
    assert codecs.expand_palmdoc(b"") == b""


def test_wide_variant():
    assert codecs.expand_palmdoc(b"abc\x80\x03", wide=True) == b"abcabc"
    assert codecs.expand_palmdoc(b"abc" + bytes((0xC0 | 2 << 2, 1)), wide=True)[:3] == b"abc"
    assert codecs.expand_palmdoc(b"a\xbf\xff", wide=True) == b"aaaa"  # a distance is held to what is there


def test_blocks_are_limited_and_separate():
    data = bytes(range(256)) * 40
    packed = codecs.pack_words(data, 256)
    text, sizes = codecs.inflate_words(packed)
    assert sizes == [256] * 32 and text == data[: 32 * 256]


def test_bad_streams():
    assert codecs.inflate_words(b"") is None
    assert codecs.inflate_words(b"\xff" * 40) is None  # 288 literal codes
    packed = codecs.pack_words(b"hello world, hello world")
    assert codecs.inflate_words(packed[: codecs_tree_bytes()]) is None
    cut = codecs.inflate_words(packed[:-8])
    assert cut is not None and b"hello world, hello world".startswith(cut[0])  # words that run out end the block


def codecs_tree_bytes() -> int:
    return len(codecs.pack_words(b""))


def test_text_record_places():
    body = codecs.pack_words(b"Some readable text, long enough to be scored. " * 4)
    text = b"Some readable text, long enough to be scored. " * 4
    assert codecs.decode_text_record(b"\x04\x00" + bytes(34) + body)[0] == text
    assert codecs.decode_text_record(b"\x04\x00" + bytes(6) + body)[0] == text  # at word 2
    assert codecs.decode_text_record(bytes(20)) is None


def test_charsets():
    assert codecs.lenient_utf8("é日😀".encode()) == "é日😀"
    assert codecs.lenient_utf8(b"a\x80b") == "a?b" and codecs.lenient_utf8(b"\xe2\x82") == "??"
    assert codecs.lenient_utf8(b"\xc3\x41") == chr(0x3 << 6 | 1)
    assert codecs.looks_utf8("é".encode()) and not codecs.looks_utf8(b"plain") and not codecs.looks_utf8(b"\xe9t\xe9")
    assert not codecs.looks_utf8(b"a" * 499 + "é".encode())  # only the first 500 bytes count


def test_contents_entries():
    data = b"\x04\x08" + b"\x00\x10\x03\x00One" + b"\x00\x20\x00\x00" + b"\x01\x00\x02\x00Tw" + b"\x00\x01\x09\x00cut"
    assert codecs.toc_entries(data, 2) == [{"title": "One", "target_offset": 16}, {"title": "Tw", "target_offset": 256}]
    assert codecs.toc_entries(b"", 0) == []


def page_tree(kind: int, deltas: bytes, count: int, extra: bytes = b"") -> bytes:
    head = bytes((4, 0, 0, 0, 4, 0, 0, 0))  # the header at 4 is 4 long and lists one sub-tree
    base = len(head) + 4
    body = bytearray(16) + extra
    body[0], body[2], body[6:8] = len(body), kind, count.to_bytes(2, "big")
    return head + base.to_bytes(2, "big") + b"\x00\x01" + bytes(body) + deltas


def test_page_deltas():
    of = lambda data: [d["delta"] for d in codecs.page_deltas(data)]
    assert of(page_tree(0, b"\x00\x09\xff", 3)) == [1, 10, 256]
    assert of(page_tree(1, b"\x05\x85", 2, b"\x02")) == [6, 6 + 2 * 128]
    assert of(page_tree(2, b"\x01\x00\x00\x00", 2)) == [257, 1]
    assert of(page_tree(3, b"\x80\x01", 1, b"\x00\x03")) == [2 + 3 * 32768]
    assert of(page_tree(0, b"\x00", 5)) == [1]  # cut off
    assert codecs.page_deltas(b"\x00" * 20) == [] and codecs.page_deltas(b"\x04") == []
