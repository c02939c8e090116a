"""Operators on texts against brute force, with nulls, empty and long texts, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from leafspark.llm import chat, chat_template, components, media, near_dedup, packing, pieces, quality_rules, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, phrase string, bucket int, sketch string, recurring string, again boolean"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", "p", 1, "k", "r", True) for d, t in rows], SCHEMA)


def corpus(seed: int = 5, n: int = 60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [text(45), text(30)]
    rows = []
    for d in range(n):
        kind = d % 6
        if kind == 0:
            t = text(rng.randint(0, 80))
        elif kind == 1:
            t = text(20) + "\n " + shared[d % 2] + " \t" + text(15)
        elif kind == 2 and rows:
            t = rng.choice(rows)[1]
        elif kind == 3 and rows:
            w = (rng.choice(rows)[1] or "a b").split() or ["x"]
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 4:
            t = text(3) + " " + "same word again " * rng.randint(1, 20)
        else:
            t = text(120).upper()
        rows.append((d * 3 % n if n % 3 else d, t))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "One"), (1005, "x" * 5000), (1006, shared[0] + " " + shared[0])]


def split(text):
    return WORDS.findall((text or "").encode())


def test_near_duplicates(spark):
    rows = corpus()
    sets = {}
    for d, t in rows:
        w = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = near_dedup.near_duplicates(table(spark, [*rows, (None, "one"), rows[0]]), size=4).collect()
    assert len(found) == len(rows) + 2
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None} == {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)]


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for d in range(1, 150):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(60)] = f"n{rng.random()}"
        rows.append((d, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(57)} for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = near_dedup.near_duplicates(table(spark, rows), size=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {d: find(d) for d in range(len(rows))}


def test_large_sets_just_under_the_threshold_are_no_link():
    n, rng = 200_000, np.random.default_rng(1)
    shared = int(n * 16 / 18) - 4  # 160 n = 180 shared is the threshold of 80 %
    values = rng.integers(0, 2**64, 2 * n - shared + 10, dtype=np.uint64)
    rows = {"doc_id": [1, 2], "component": [1, 2], "block": [0, 0], "band": [0, 0], "low": [0, 0], "high": [0, 0], "bucket": [5, 5], "sketch": [bytes(2 * near_dedup.COORDINATES)] * 2}
    for more, linked in ((0, []), (5, [(2, 1)])):
        sets = [np.sort(v) for v in (values[:n], values[n - shared - more : 2 * n - shared - more])]
        assert (100 * near_dedup._common(*sets) >= 80 * (2 * n - shared - more)) == bool(linked)
        table = pa.table({**rows, "shingles": [x.tobytes() for x in sets]})
        out = list(near_dedup._block_links(80)(iter(table.to_batches())))
        assert [(r["u"], r["v"]) for b in out for r in b.to_pylist()] == linked
        assert sum(b.num_rows for b in near_dedup._open_members(80)(iter(table.to_batches()))) == 2


def test_groups_are_whole_over_batches():
    seen = []

    def work(rows):
        seen.append(rows.column("bucket").to_pylist())
        return rows

    table = pa.table({"bucket": [1] * 5 + [2] * 4 + [3], "low": [0] * 10, "high": [0, 0, 0, 1, 1, *[0] * 5]})
    out = list(near_dedup._in_groups(work)(iter(table.to_batches(max_chunksize=2))))
    assert seen == [[1] * 3, [1] * 2, [2] * 4, [3]] and pa.Table.from_batches(out).equals(table)


def test_blocks_of_a_bucket_miss_no_link(spark, monkeypatch):
    """Two chains of near copies over many small blocks, split by number of members and by size of sets."""
    rng = random.Random(12)
    rows = []
    for chain in range(2):
        w = [f"c{i}" for i in range(70)]
        w[:4] = [f"k{chain}{i}" for i in range(4)]
        for d in range(60):
            w = list(w)
            w[rng.randrange(70)] = f"n{rng.random()}"
            rows.append((chain * 60 + d, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(67)} for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for block, shingles in ((4, 10**9), (1024, 300)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
        found = near_dedup.near_duplicates(table(spark, rows), size=4).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == {d: find(d) for d in range(len(rows))}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    shares = []
    for k in (1, 5, 40, 400):
        sets = [a[:k], np.concatenate([a[: k // 2], a[-(k - k // 2) :]])]
        s = near_dedup.sketches(np.concatenate(sets), np.array([0, k, k + len(sets[1])]))
        shares.append(((s[0] == s[1]).mean(), len(np.intersect1d(*sets)) / len(np.union1d(*sets))))
    assert all(abs(x - y) < 0.16 for x, y in shares)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(None, 1), (7, 7)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for u, v in edges:
        if u is not None and u != v:
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for u, v in edges if u is not None and u != v for x in (u, v)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def removed_words(rows, window):
    seen, out = set(), {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[d] = (w, gone)
    return out


@pytest.mark.parametrize("window,phrase", [(20, 5), (8, 3)])
def test_substring_dedup(spark, window, phrase):
    rows = corpus(9)
    found = {r["doc_id"]: r for r in substring_dedup.deduplicate(table(spark, [*rows, (None, "null id")]), window, phrase).collect()}
    assert found.pop(None)["text"] == "null id"
    expected = removed_words(rows, window)
    assert set(found) == set(expected)
    for d, (w, gone) in expected.items():
        assert (found[d]["n_words"], found[d]["n_removed"]) == (len(w), sum(gone))
        assert found[d]["text"].encode() == b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert sum(r["words"] for r in found[d]["removed"]) == sum(gone)
    assert any(sum(g) for _, g in expected.values())


def test_substring_dedup_keeps_the_layout(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(1, f"Head\n\n{passage}\nTail"), (2, f"  Own\twords\n{passage}\n\nand after \n"), (3, passage)]
    found = {r["doc_id"]: r for r in substring_dedup.deduplicate(table(spark, rows), keep_layout=True, carry=("lang", "source")).collect()}
    assert found[1]["text"] == rows[0][1] and found[2]["text"] == "  Own\twords\nand after \n" and found[3]["text"] == ""
    assert found[2]["carried"]["source"] == "s2" and found[2]["carried"]["lang"] == "en"


def test_carried_columns_of_any_name(spark):
    names = ["n_removed", "removed", "n_words", "recurring", "firsts", "carried", "a.b", "phrase", "c0"]
    frame = spark.createDataFrame([(1, "a b", *range(9)), (None, "c", *range(9))], ", ".join(["doc_id long", "text string", *(f"`{n}` int" for n in names)]))
    for r in substring_dedup.deduplicate(frame, carry=tuple(n for n in names if "." not in n)).collect():
        assert r["carried"].asDict() == {n: i for i, n in enumerate(names) if "." not in n} and r["n_removed"] == 0


def test_rows_that_share_a_doc_id_are_judged_each(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(5, passage), (5, passage), (5, f"x {passage}"), (4, "a b"), (6, f"{passage} y")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.deduplicate(table(spark, rows)).collect())
    assert got == [(4, 2, 0), (5, 25, 0), (5, 25, 0), (5, 26, 0), (6, 26, 25)]


def test_a_clash_of_window_hashes_removes_nothing(spark, monkeypatch):
    """Two windows of one hash: their words' other hashes tell them apart."""
    whole = substring_dedup.shingle_hashes

    def clashing(h, k):
        return np.full(max(len(h) - k + 1, 0), 77, dtype=np.uint64) if k == 20 and not getattr(h, "other", False) else whole(np.asarray(h), k)

    class Other(np.ndarray):
        other = True

    real = substring_dedup.run_hashes
    monkeypatch.setattr(substring_dedup, "shingle_hashes", clashing)
    monkeypatch.setattr(substring_dedup, "run_hashes", lambda *a, seed=0: real(*a, seed=seed).view(Other) if seed else real(*a))
    shared = "one same phrase of five"
    own = lambda d: " ".join(f"d{d}w{i}" for i in range(15))
    texts = [f"{shared} {own(1)}", f"{shared} {own(2)}", f"{shared} {own(1)}"]
    found = pa.array([[int(x) for x in np.unique(substring_dedup.Shard(pa.array(texts), 20, 5).phrases).view(np.int64)]] * 3)
    shard = substring_dedup.Shard(pa.array(texts), 20, 5)
    at, value, check = shard.candidates(found)
    assert set(value.tolist()) == {77} and len(at) == 3
    assert check[0] == check[2] != check[1]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    rows = [*corpus(4), (None, "no id"), (2000, "Don't İstanbul ΣΑΣ x2 3.5% \x1cab <|endoftext|> éa　b 😀!! naïve, ÀÉß×÷"), (2001, "many words here " * 900)]
    got = packing.pack(table(spark, rows), path, 2, capacity=256, classes=8).collect()
    whole = defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append(r)
    texts = dict(rows)
    for d, mine in whole.items():
        mine.sort(key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in mine), dtype="<u4").tolist()
        assert ids == [*reference.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist()
        assert {r["doc_tokens"] for r in mine} == {len(ids)}
    assert set(whole) == set(texts)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append(r)
    padding = filled = 0
    for mine in held.values():
        mine.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in mine)
        assert [r["offset"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist() and total <= 256
        padding += 0 if total & (total - 1) == 0 else 256 - total
        filled += total
    assert padding <= 0.05 * filled


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    odd = ["  two  spaces\n\n\ttab \r\n", " ", "日本語テキスト。 12345 3.14", "http://a.b/c?d=" + "f0" * 200, "😀\x00\x01", "end ", "supercalifragilistic" * 10]
    odd += ["日本語のテキスト、空白のない文。" * 400, "a" * 3000, "=-" * 900, "".join(rng.choice("theandSpecial_$") for _ in range(5000)), "".join(rng.choice("0123456789abcdef") for _ in range(4000))]
    odd += ["".join(rng.choice("ab \n.éñ日😀THEing'01") for _ in range(rng.randrange(120))) for _ in range(60)]
    rows = [*corpus(6), *enumerate(odd, 3000), (None, "no id")]
    got = pieces.decode(pieces.encode(table(spark, rows), path), path).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() == model.encode(text)
        assert r["text"] == text


def test_piece_occurrences_are_all_found():
    model = pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    text = np.array([ord(c) for c in "▁the▁then▁in▁thin"], dtype=np.int32)
    begin, piece = pieces.occurrences(text, model)
    whole = "".join(map(chr, text))
    names = ["".join(chr(c) for c in model.texts[p][: model.lengths[p]]) for p in range(len(model.texts))]
    expected = {(i, p) for p, n in enumerate(names) for i in range(len(whole)) if whole.startswith(n, i)}
    assert set(zip(begin.tolist(), piece.tolist(), strict=True)) == expected
    assert (np.diff(begin) >= 0).all()


def test_media_round_trip(spark, tmp_path):
    rows = [*corpus(2), (None, "no id"), (1000, "again")]
    folder = f"file://{tmp_path}/media"
    assert media.store_media(table(spark, rows), folder, archive_bytes=4000) > 1
    spark.dataSource.register(media.MediaArchiveSource)
    members = spark.read.format("media_archive").option("rangeBytes", 1500).load(folder)
    got = media.decode_media(members).collect()
    key = lambda d, t: (-1 if d is None else d, t)
    assert sorted(key(r["doc_id"], bytes(r["payload"])[: r["n_bytes"]]) for r in got) == sorted(key(d, (t or "").encode()) for d, t in rows)
    for r in got:
        n = len(r["payload"])
        assert n % 64 == 0 and n >= 64 and n - r["n_bytes"] < 65 and not any(bytes(r["payload"])[r["n_bytes"] :])
    by_text = defaultdict(set)
    for r in got:
        by_text[bytes(r["payload"])[: r["n_bytes"]]].add((bytes(r["media"]), r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def samples_of_png(media_bytes):
    """What the PNG format says of an 8-bit grey image, byte by byte and with all five row filters."""
    import zlib

    assert media_bytes[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, body, size = 8, b"", None
    while at < len(media_bytes):
        n = int.from_bytes(media_bytes[at : at + 4], "big")
        kind, data = media_bytes[at + 4 : at + 8], media_bytes[at + 8 : at + 8 + n]
        assert int.from_bytes(media_bytes[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + data)
        if kind == b"IHDR":
            size = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
            assert tuple(data[8:]) == (8, 0, 0, 0, 0)
        elif kind == b"IDAT":
            body += data
        at += 12 + n
    assert kind == b"IEND"
    raw, (width, height) = zlib.decompress(body), size
    assert len(raw) == height * (width + 1)
    out, above = bytearray(), bytes(width)
    for y in range(height):
        how, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = line[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line[x] = line[x] + (0, a, b, (a + b) // 2, nearest)[how] & 255
        out += line
        above = bytes(line)
    return bytes(out)


def test_media_by_another_reader(spark, tmp_path):
    """The stored images by a reader of the format's own rules, and the features counted in plain Python."""
    from math import isqrt

    rows = [*corpus(5), (None, "no id"), (3000, "é" * 33), (3001, "x" * 64), (3002, "y" * 65)]
    texts = {d: (t or "").encode() for d, t in rows}
    got = media.media_columns(table(spark, rows), f"file://{tmp_path}/other").collect()
    assert len(got) == len(rows)
    for r in got:
        want = texts[r["doc_id"]]
        want += bytes(-len(want) % 64 if want else 64)
        assert samples_of_png(bytes(r["media"])) == bytes(r["payload"]) == want
        n, total = len(want), sum(want)
        spread = sum(x * x for x in want) * n - total * total
        steps = sum(abs(a - b) > 32 for a, b in zip(want, want[1:], strict=False))
        bins = "/".join(str(sum(x // 32 == k for x in want)) for k in range(8))
        mean, deviation, *rest = r["feature"].split(";")
        assert (mean, rest) == (f"mean={100 * total // n}", [f"steps={steps}", f"bins={bins}"])
        assert abs(int(deviation.removeprefix("deviation=")) - isqrt(10_000 * spread) // n) <= 1


def test_media_manifest_is_compact(spark, tmp_path, monkeypatch):
    """Many writing tasks leave one file to plan from; each file of a manifest is opened once."""
    from pyarrow import fs

    rows = [(i, f"text {i} " * 20) for i in range(60)]
    folder = f"file://{tmp_path}/media"
    n = media.store_media(table(spark, rows).repartition(12), folder, archive_bytes=500)
    files = [p.name for p in (tmp_path / "media" / media.MANIFEST).glob("*.parquet")]
    assert n > 12 and len(files) == 1 and not (tmp_path / "media" / f"{media.MANIFEST}-parts").exists()
    opened = []

    class Store:
        inner = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def open_input_file(self, path):
            opened.append(path)
            return self.inner.open_input_file(path)

    monkeypatch.setattr(media, "file_system", lambda uri: (Store(), str(tmp_path / "media")))
    assert len(media.MediaArchiveReader({"path": folder, "rangeBytes": "700"}).partitions()) > 12 and len(opened) == 1


def test_folders_are_released_by_the_thread_that_took_them(spark):
    """A scope that ends in one thread leaves what another thread has taken."""
    import threading

    from leafspark.llm import scratch

    entered, left, seen = threading.Event(), threading.Event(), []

    def other():
        with scratch.released(spark):
            frame = scratch.saved(spark.range(5), "other")
            entered.set()
            left.wait(60)
            seen.append(frame.count())

    worker = threading.Thread(target=other)
    with scratch.released(spark):
        worker.start()
        entered.wait(60)
        mine = scratch.saved(spark.range(3), "mine")
        assert mine.count() == 3
    left.set()
    worker.join(60)
    assert seen == [5]


def test_media_members_are_retried_alone(tmp_path):
    class Store:
        """Fails on the first two openings of a member's archive."""

        def __init__(self, inner):
            self.inner, self.opened = inner, 0

        def open_input_file(self, path):
            self.opened += 1
            if self.opened < 3:
                raise OSError("gone for a moment")
            return self.inner.open_input_file(path)

    import zipfile

    from pyarrow import fs

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/1/5.png", b"first")
        z.writestr("1/2/6.png", b"second")
    infos = zipfile.ZipFile(tmp_path / "a.zip").infolist()
    reader = media.MediaArchiveReader({"path": str(tmp_path), "attempts": "3"})
    store = Store(fs.LocalFileSystem())
    reader.wait = 0.01
    assert reader.member(store, str(tmp_path / "a.zip"), infos[1]) == (b"second", None)
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[infos[0].header_offset + 40] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    bad, error = reader.member(fs.LocalFileSystem(), str(tmp_path / "a.zip"), infos[0])
    assert bad is None and error
    assert reader.member(fs.LocalFileSystem(), str(tmp_path / "a.zip"), infos[1])[0] == b"second"


@pytest.mark.parametrize("piece,most", [(100, 100_000), (4_000_000, 100_000), (700, 3)])
def test_media_ranges_are_read_in_pieces(tmp_path, monkeypatch, piece, most):
    """Every member once, whatever the ranges and pieces; a damaged one alone is read anew."""
    import zipfile

    import pyarrow.parquet as pq
    from pyarrow import fs

    rng = random.Random(7)
    (tmp_path / "_archives").mkdir()
    expected, listed = {}, []
    for k in range(4):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for m in range(30):
                expected[f"{k}.zip", f"{m}/{m}/1.png"] = rng.randbytes(rng.randrange(0, 300))
                z.writestr(zipfile.ZipInfo(f"{m}/{m}/1.png"), expected[f"{k}.zip", f"{m}/{m}/1.png"])
        listed.append((f"{k}.zip", (tmp_path / f"{k}.zip").stat().st_size))
    for i, part in enumerate((listed[:3], listed[3:])):
        pq.write_table(pa.table({"archive": [a for a, _ in part], "bytes": pa.array([n for _, n in part], type=pa.int64())}), tmp_path / "_archives" / f"part-{i}.parquet")
    opened = []

    class Store:
        def __init__(self):
            self.inner = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def open_input_file(self, path):
            opened.append(path)
            return self.inner.open_input_file(path)

    monkeypatch.setattr(media, "file_system", lambda uri: (Store(), str(tmp_path)))
    reader = media.MediaArchiveReader({"path": str(tmp_path), "rangeBytes": "1500", "pieceBytes": str(piece), "mostPartitions": str(most), "attempts": "1", "onError": "row"})
    planned = reader.partitions()
    assert len(planned) <= most + 2
    opened.clear()
    got = [r for p in planned for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == len(expected) and {(r["archive"], r["member"]): r["media"] for r in got} == expected
    if piece > 1500:
        assert len(opened) < 60  # a directory and a piece for each range of an archive, and the manifest
    info = zipfile.ZipFile(tmp_path / "1.zip").infolist()[4]
    raw = bytearray((tmp_path / "1.zip").read_bytes())
    raw[info.header_offset] ^= 1
    (tmp_path / "1.zip").write_bytes(bytes(raw))
    got = [r for p in planned for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == len(expected) and [(r["archive"], r["member"]) for r in got if r["error"]] == [("1.zip", info.filename)]


def base_counts(text):
    w = [x.decode() for x in split(text)]
    keys = defaultdict(list)
    for i in range(len(w) - 7):
        keys[tuple(w[i : i + 8])].append(i)
    covered = {p for at in keys.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rows = [*corpus(3), (1100, "a#b $$ <x> |&%*"), (1101, "same line\nsame line\n\nother\nsame line"), (None, "x")]
    got = quality_rules.apply_rules(table(spark, rows).withColumnRenamed("source", "host")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, *rest = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n) and not (r["base_failed"] and r["kept"])


def test_lines_of_many_documents_are_removed(spark):
    own = lambda d: " ".join(f"word{d}x{i}" for i in range(24))
    menu = " ".join(f"Menu{i}" for i in range(30))
    rows = [(d, f"{own(d)}\n{menu if d % 2 else menu.upper() + '  '}") for d in range(40)] + [(d, own(d)) for d in range(40, 80)]
    frame = spark.createDataFrame([(d, t, "h") for d, t in rows], "doc_id long, text string, host string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(frame).collect()}
    assert all(got[d]["n_removed_words"] == 30 and not got[d]["kept"] for d in range(40))
    assert all(got[d]["n_removed_words"] == 0 and got[d]["kept"] for d in range(40, 80))
    strict = quality_rules.apply_rules(frame, quality_rules.Rules(kept_share=0.3)).collect()
    assert all(r["kept"] for r in strict)


def test_copies_of_a_text_are_one_document_of_their_host(spark):
    """Neither repeated rows nor copies under other ids make a line frequent, nor do they thin out the shares of a host."""
    own = lambda d: " ".join(f"word{d}x{i}" for i in range(24))
    menu = " ".join(f"menu{i}" for i in range(30))
    rows = [(1, own(1), "small")] * 15 + [(d, own(2), "small") for d in range(2, 30)] + [(None, f"{own(3)}\n{menu}", "none")] * 11
    rows += [(d, f"{own(d)}\n{menu}", "large") for d in range(100, 112)] + [(d, own(d), "large") for d in range(112, 160)] + [(160, own(160), "large")] * 2000
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        gone = r["doc_id"] is not None and 100 <= r["doc_id"] < 112
        assert r["kept"] != gone and (r["n_removed_words"] > 0) == gone, r


@pytest.mark.parametrize("percent,gone", [(1, False), (3, True), (9, True)])
def test_a_line_of_a_few_percent_of_a_host_is_removed(spark, percent, gone):
    own = lambda d: " ".join(f"word{d}x{i}" for i in range(24))
    menu = " ".join(f"menu{i}" for i in range(30))
    rows = [(d, f"{own(d)}\n{menu}" if d < 8 * percent else own(d), "h") for d in range(800)]
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, host string")).where("NOT kept").collect()
    assert sorted(r["doc_id"] for r in got) == (list(range(8 * percent)) if gone else [])
    assert all(r["n_removed_words"] == 30 for r in got)


def test_no_python_in_quality_rules(spark):
    plan = quality_rules.with_statistics(table(spark, corpus(3)).withColumnRenamed("source", "host"), quality_rules.Rules())._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 1, "assistant", "<says>#### \\\\"), (1, 0, "user", None), (1, 2, None, "x\n### y"), (2, 0, "assistant", ""), (None, 0, "user", "z"), (None, 0, "assistant", "y"), (None, 0, "assistant", "y"), (3, None, "user", "first"), (3, 0, "assistant", "é😀")]
    frame = spark.createDataFrame([(*t, 5, "x") for t in turns], "conv_id long, turn long, role string, text string, piece int, learned string")
    found = chat.read_back(chat.format_conversations(frame)).collect()
    assert sorted((r["n_turns"], r["loss_chars"]) for r in found if r["conv_id"] is None) == [(1, 0), (1, 1), (1, 1)]
    got = {r["conv_id"]: r for r in found if r["conv_id"] is not None}
    by = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        loss = "".join(x for _, role, x in rows if role == "assistant")
        assert got[c]["n_turns"] == len(rows)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_a_long_turn_takes_little_memory():
    import tracemalloc

    text = "word <b> ## \\\\ " * 200_000
    pieces_of = list(chat.joined(chat_template.compile_template(chat.TEMPLATE, chat.CONTROLS)(messages=iter([{"role": "user", "text": text}]))))
    batch = pa.record_batch([pa.array([1] * len(pieces_of)), pa.array(range(len(pieces_of))), pa.array([t for t, _ in pieces_of]), pa.array([m for _, m in pieces_of])], names=["conv_id", "piece", "text", "learned"])
    whole = sum(len(t) for t, _ in pieces_of)

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    run = chat.read_back(Frame())
    tracemalloc.start()
    (out,) = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist()[0]["n_turns"] == 1 and peak < 12 * whole


def render(source, **env):
    return list(chat_template.compile_template(source, ("<s>",), env)(**env))


def test_templates():
    text = lambda s, **env: "".join(t for t, _ in render(s, **env))
    m = [{"role": "user", "text": "a<s>b"}, {"role": "bot", "text": "c\\"}]
    assert text("{% for x in m %}{{ loop.index }}{{ x.role | upper }}{% if not loop.last %},{% endif %}{% endfor %}", m=iter(m)) == "1USER,2BOT"
    assert text("{% for x in m %}{{ x['text'] | escape }};{% endfor %}", m=m) == "a\\<s>b;c\\\\;"
    assert text("{% if m == 1 %}one{% elif m == 2 %}two{% else %}many{% endif %}", m=2) == "two"
    assert text("{% set y = m ~ 'z' %}{{ y if m in 'abc' else 'no' }}{# gone #}", m="b") == "bz"
    assert render("a{% generation %}b{{ m }}{% endgeneration %}", m=1) == [("a", False), ("b", True), ("1", True)]
    folded = chat_template.Parser("{{ 'a' ~ 1 ~ 2 if true else m }}{% if false %}x{% endif %}b", {"m"}, chat_template.FILTERS).block()[0]
    assert len(folded) == 1 and folded[0][0] == "text"


@pytest.mark.parametrize("bad", ["{{ other }}", "{{ m.__class__ }}{{", "{{ m() }}", "{% for x m %}{% endfor %}", "{% if m %}", "{{ m | nofilter }}", "{% import os %}", "{{ 1 + }}", "{% set loop = 1 %}"])
def test_templates_stay_in_their_box(bad):
    with pytest.raises(chat_template.TemplateError):
        list(render(bad, m="x"))


def test_unescape_reverses_escape():
    rng = random.Random(5)
    controls = chat.CONTROLS
    for _ in range(300):
        t = "".join(rng.choice(["#", "##", "###", "\\", "<says>", "</turn>", "<", "a", "\n"]) for _ in range(rng.randrange(12)))
        assert chat_template.unescape(controls, chat_template.escape(controls, t)) == t


def test_empty_tables(spark):
    none = table(spark, [])
    path, spm = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert near_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.deduplicate(none).count() == 0
    assert packing.pack(none, path, 2).count() == 0
    assert pieces.decode(pieces.encode(none, spm), spm).count() == 0
    assert quality_rules.apply_rules(none.withColumnRenamed("source", "host")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0


def test_media_of_an_empty_table(spark, tmp_path):
    assert media.media_columns(table(spark, []), f"file://{tmp_path}/none").count() == 0


def test_words_of_rows_stay_apart():
    from leafspark.llm.arrow_text import run_hashes, utf8, words

    data, ends = utf8(pa.array(["ab", "cd e", None, "", " f"], type=pa.large_string()))
    starts, stops, first = words(data, ends)
    assert [data[a:b].tobytes() for a, b in zip(starts, stops, strict=True)] == [b"ab", b"cd", b"e", b"f"] and first.tolist() == [0, 1, 3, 3, 3, 4]
    names = [f"word{i}" * (1 + i % 5) for i in range(5000)]
    data, ends = utf8(pa.array([" ".join(names)]))
    starts, stops, _ = words(data, ends)
    assert len(set(run_hashes(data, starts, stops).tolist())) == len(set(names))
    assert zlib.crc32(b"") == 0


def test_a_table_of_pieces_takes_few_bytes_for_each():
    from leafspark.llm.packing import PieceTable

    rng, table, place = np.random.default_rng(3), PieceTable(), {}
    for n in (0, 1, 5_000, 5_000):
        keys = rng.integers(0, 1 << 64, n, dtype=np.uint64).tolist()
        assert (table.find(keys) == -1).all()
        place |= {k: len(place) + i for i, k in enumerate(keys)}
        table.add(keys, np.arange(2 * n, dtype="<u4"), np.full(n, 2))
    assert table.find(list(place)).tolist() == list(place.values()) and len(table.index) == len(place)
    assert sum(x.nbytes for x in vars(table).values()) < 40 * len(place)
    assert table.gather(table.find(list(place)[-2:]))[0].tolist() == [9996, 9997, 9998, 9999]
