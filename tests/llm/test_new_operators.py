"""Fill-in-the-middle and best-fit packing against brute force, with nulls, empty and odd texts, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafspark.llm import best_fit, fill_in_middle

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [
    None, "", " ", " \n\t ", "a", " a", "a ", "  a  b", "é ü\n\nß  ", "x<P>y", "<M>", "it's  we'll\n'tis", "a  b  c", "1a2 b3_c--d", "tab\tand  two\n\n\nlines ",
    "<|endoftext|> a<|endoftext|>\n b", "日本 語 text", "𐐷 x", "ªº ×÷", "a" * 5000, "word " * 3000, "…’quoted’ — dash", "\u0085x y", "\x1c a \x00 b\x7f",
]


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "o", 1, "f", 5, 7) for d, t in rows], "doc_id long, text string, output string, h1 int, form string, rank int, task int")


def corpus():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cé\n <PSM>") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = list(enumerate(texts + ODD_TEXTS))
    return [*rows, (None, "no id here"), rows[5], (7, "the same id again")]


def forms(doc_id, text):
    tokens = TOKENS.findall(text or "")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    draws = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in draws[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text or ""
    prefix, middle, suffix = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if draws[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rows = corpus()
    found = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, rows))).collect()
    want = Counter((d, *forms(d, t), t or "") for d, t in rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in found) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, []))).collect() == []


@given(st.text(alphabet=" \t\nabé日", max_size=80))
@settings(max_examples=200, deadline=None)
def test_boundaries_and_ranks(text):
    data = text.encode()
    ends = fill_in_middle.boundaries(data)
    tokens = TOKENS.findall(text)
    assert ends.bit_count() == len(tokens)
    for rank in range(1, len(tokens) + 1):
        assert data[: len(data) - fill_in_middle.ranked(ends, len(data), rank)].decode() == "".join(tokens[:rank])


def test_a_long_text_is_cut_whole():
    text = ("wörd  and\n" * 300_000).encode()
    n, a, b = fill_in_middle.cut(text, 399_999, 7)
    assert (n, text[:a].decode(), b) == (600_001, "wörd  and\nwörd  and\nwörd  and\nwörd", len("".join(TOKENS.findall(text.decode())[:399_999]).encode()))


@lru_cache(maxsize=1)
def coder():
    return best_fit.ByteTokenizer(BYTE_BPE)


def ids_of(text):
    return coder().tokenizer.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=" \t\nabZé1'|_.-  日st<>", max_size=40), max_size=4))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_librarys(texts):
    ids, limits = coder().encode(pa.array(texts, type=pa.string()))
    for t, a, b in zip(texts, limits[:-1], limits[1:], strict=True):
        assert ids[a:b].tolist() == ids_of(t), repr(t)


def test_ids_of_odd_texts_equal_the_librarys():
    ids, limits = coder().encode(pa.array(ODD_TEXTS, type=pa.string()))
    for t, a, b in zip(ODD_TEXTS, limits[:-1], limits[1:], strict=True):
        assert ids[a:b].tolist() == ids_of(t), repr(t)


def bins_of_plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=rooms.__getitem__)
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 40))
@settings(max_examples=200, deadline=None)
def test_the_plan_is_best_fit(lengths, capacity):
    counts = Counter(lengths)
    lines = best_fit.planned(counts, capacity)
    plan = best_fit.Plan(lines)
    taken = defaultdict(list)
    for n, count in counts.items():
        bins, offsets = plan.slots(np.full(count, n), np.arange(count))
        for b, o in zip(bins.tolist(), offsets.tolist(), strict=True):
            taken[b].append((o, n))
    for held in taken.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in held) for held in taken.values()) == bins_of_plain_best_fit(lengths, capacity)


def test_a_plan_stays_short_for_many_documents():
    rng = np.random.default_rng(1)
    counts = {n: int(c) for n, c in zip(range(1, 1024), rng.integers(1, 10**9, 1023), strict=True)}
    lines = best_fit.planned(counts, 1024)
    assert len(lines) < 20_000
    assert sum(x[2] * x[3] for x in lines) == sum(counts.values())


@pytest.mark.parametrize("broadcast", [True, False])
def test_best_fit_packs_every_token_once(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(best_fit, "MOST_BASES", -1)
    rng = random.Random(4)
    rows = corpus() + [(1000 + i, " ".join(rng.choice(("ab", "cde", "f!")) for _ in range(rng.randint(1, 90)))) for i in range(200)]
    found = [r.asDict() for r in best_fit.pack_best_fit(table(spark, rows).repartition(5), BYTE_BPE, end_id=2, capacity=64).collect()]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(ids_of(t) + [2])
    lengths = []
    for d, documents in want.items():
        cut = []
        for ids in documents:
            first = len(ids) % 64 or 64
            lengths.append(len(ids) % 64)
            at = [0, *range(first, len(ids), 64)]
            cut += [(i, a, ids[a:b]) for i, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True))]
        assert sorted(cut) == sorted(pieces[d])
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    whole = sum(len(ids) // 64 for documents in want.values() for ids in documents)
    assert len(sequences) == whole + len(bins_of_plain_best_fit([n for n in lengths if n], 64))
    assert best_fit.pack_best_fit(table(spark, []), BYTE_BPE, end_id=2).collect() == []
