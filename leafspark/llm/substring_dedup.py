"""Removal of word passages that repeat across or within documents, with sharded phrase automata.

1. Each window of ``window`` words is stood for by its least ``phrase``-word phrase (by hash), so equal
   windows have equal phrases and only about one phrase in eight is counted.
2. Phrases that recur are confirmed by a count over the corpus and sent to the documents that hold
   them. Every task compiles the phrases of one shard of documents (a slice of its texts) into an
   Aho-Corasick automaton and streams the shard's documents through it. The pattern that the automaton
   reports at a word is what the word's windows are known by.
3. Windows on located phrases are held against the whole corpus: the least document of each window
   keeps it. All other windows lose their words.

Streaming all documents through shards of all the corpus's passages would cost documents times shards, which
grows with the square of the corpus; so documents and passages meet by phrase first, and a shard holds only
the confirmed phrases of its documents. Texts cross the network once.

Windows are equal if 96 bits are: a 64-bit hash of the window, and 32 bits of one from other hashes of its
words. Of 6e12 different windows (100 TB) two are mistaken for each other with a chance of 2e-4. The windows that
a document keeps come back to it by the first hash alone: with a thousand windows each in 6e9 documents, the
chance that one document anywhere has two of one hash is 2e-4 as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafspark.llm.arrow_text import rolling, run_hashes, shingle_hashes, sized_slices, utf8, words
from leafspark.llm.scratch import saved

SHARD_BYTES = 1_500_000
_NONE = np.uint64(0)
_ALL = np.uint64(2**64 - 1)


class Shard:
    """The words of a slice of documents, and what stands for each of their windows."""

    def __init__(self, texts: pa.Array, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.data, self.ends = utf8(texts)
        self.starts, self.stops, self.first = words(self.data, self.ends)
        self.hashes = run_hashes(self.data, self.starts, self.stops)
        self.phrases = shingle_hashes(self.hashes, phrase)
        self.span = window - phrase + 1
        self.least = rolling(self.phrases, self.span)
        counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(counts)), counts)
        n = len(self.least)
        self.inside = np.arange(n) + window <= np.repeat(self.first[1:], counts)[:n]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and first word of each phrase that stands for a window."""
        if not len(self.least):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        edge = np.zeros(self.span - 1, dtype=np.uint64)
        stands = rolling(np.concatenate([edge, np.where(self.inside, self.least, _NONE), edge]), self.span, np.maximum)
        at = np.flatnonzero((self.phrases == stands) & (stands != _NONE))
        return self.row[at], at

    def located(self, recurring: pa.Array) -> np.ndarray:
        """The confirmed phrase (0: none) that begins at each word, as the automaton finds it in the streamed documents."""
        found = np.zeros(len(self.phrases), dtype=np.uint64)
        recurring = recurring.cast(pa.large_list(pa.int64()))
        held = recurring.is_valid().to_numpy(zero_copy_only=False)
        if not held.any() or not len(self.least):
            return found
        row, at = self.anchors()
        wanted = np.unique(recurring.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        at = at[np.isin(self.phrases[at], wanted)]
        lengths = self.stops - self.starts
        streams: dict[int, tuple[str, np.ndarray]] = {}
        for r in np.flatnonzero(held):
            a, b = self.first[r], self.first[r + 1]
            if b - a >= self.window:
                text = self.data[self.ends[r] : self.ends[r + 1]].tobytes()
                streams[int(r)] = (b" ".join([b"", *text.split(), b""]).decode("latin-1"), np.concatenate([[1], 1 + np.cumsum(lengths[a:b] + 1)]))
        automaton = ahocorasick.Automaton()
        patterns: list[np.uint64] = []
        _, one_of_each = np.unique(self.phrases[at], return_index=True)
        for q in at[one_of_each]:
            r = int(self.row[q])
            if r in streams:
                text, begins = streams[r]
                i = q - self.first[r]
                automaton.add_word(text[begins[i] - 1 : begins[i + self.phrase]], len(patterns))
                patterns.append(self.phrases[q])
        if not patterns:
            return found
        automaton.make_automaton()
        value = np.array(patterns, dtype=np.uint64)
        for r, (text, begins) in streams.items():
            hits = np.fromiter(automaton.iter(text), dtype=np.dtype((np.int64, 2)))
            if len(hits):
                found[self.first[r] + np.searchsorted(begins, hits[:, 0] + 1) - self.phrase] = value[hits[:, 1]]
        return found

    def candidates(self, recurring: pa.Array, checked: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, hash and, if they are to be ``checked``, check of the windows that a located phrase stands for."""
        found = self.located(recurring)
        if not found.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        known = rolling(np.where(found != _NONE, found, _ALL), self.span)
        at = np.flatnonzero((known == self.least) & self.inside)
        value = shingle_hashes(self.hashes, self.window)[at]
        if not checked:
            return at, value, np.zeros(0, dtype=np.uint32)
        check = shingle_hashes(run_hashes(self.data, self.starts, self.stops, seed=1), self.window)[at] >> np.uint64(32)
        return at, value, check.astype(np.uint32)


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """A number for each different combination of keys, in the order of their first places."""
    out = np.zeros(len(keys[0]), dtype=np.int64)
    for k in keys:
        codes, found = pd.factorize(k)
        out = pd.factorize(out * (len(found) + 1) + codes)[0]
    return out


def deduplicate(docs: DataFrame, window: int = 20, phrase: int = 5, keep_layout: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word covered by a window of words that also starts earlier.

    ``docs`` has doc_id and text. Earlier means in a smaller doc_id, or before in the same document.
    Returns doc_id, n_words, n_removed, removed (runs of removed words: first, words), text (the kept words
    joined by one space, or with ``keep_layout`` the original text without the bytes from each removed run
    to the next kept word) and carried: a struct of the columns named in ``carry``, whatever their names.

    A null text has no words; a row with a null doc_id takes no part and keeps its words; documents shorter
    than a window lose nothing; other columns are ignored; an empty table gives no rows. Rows that share a
    doc_id are judged each by itself against other documents, so repeated rows get equal results.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("none")).alias("carried"))
    numbered = rows.where(F.col("doc_id").isNotNull())

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text", SHARD_BYTES):
                shard = Shard(part.column("text"), window, phrase)
                row, at = shard.anchors()
                doc, value = part.column("doc_id").to_numpy()[row], shard.phrases[at]
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                begins = np.flatnonzero(new)
                again = np.diff(np.append(begins, len(doc))) > 1
                yield pa.record_batch([pa.array(value[begins].view(np.int64)), pa.array(doc[begins]), pa.array(again)], names=["phrase", "doc_id", "again"])

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text", SHARD_BYTES):
                shard = Shard(part.column("text"), window, phrase)
                at, value, check = shard.candidates(part.column("recurring"))
                doc = part.column("doc_id").to_numpy()[shard.row[at]]
                order = np.argsort(doc, kind="stable")
                new = order[~pd.Series(_numbered(value, check)[order]).duplicated().to_numpy()]
                yield pa.record_batch([pa.array(value[new].view(np.int64)), pa.array(check[new].view(np.int32)), pa.array(doc[new])], names=["window", "check", "doc_id"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text", SHARD_BYTES):
                yield _cleaned(part, window, phrase, keep_layout).append_column("carried", part.column("carried"))

    anchors = saved(numbered.select("doc_id", "text").mapInArrow(list_anchors, "phrase long, doc_id long, again boolean"), "phrases")
    recurring = anchors.groupBy("phrase").agg(F.count("*").alias("n"), F.max("again").alias("again")).where((F.col("n") > 1) | F.col("again")).select("phrase")
    by_doc = anchors.select("phrase", "doc_id").join(recurring, "phrase", "left_semi").groupBy("doc_id").agg(F.collect_list("phrase").alias("recurring"))
    marked = numbered.join(by_doc, "doc_id", "left")
    firsts = (
        marked.where(F.col("recurring").isNotNull())
        .mapInArrow(list_windows, "window long, check int, doc_id long")
        .groupBy("window", "check")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_list("window").alias("firsts"))
    )
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, removed array<struct<first:int,words:int>>, text string").add("carried", rows.schema["carried"].dataType)
    found = marked.join(firsts, "doc_id", "left").mapInArrow(remove, schema)
    none = {"recurring": F.lit(None).cast("array<long>"), "firsts": F.lit(None).cast("array<long>")}
    unnumbered = rows.where(F.col("doc_id").isNull()).withColumns(none)
    named = F.struct(*[F.col("carried").getField(f"c{i}").alias(c) for i, c in enumerate(carry)]) if carry else F.lit(None).cast("struct<>")
    return found.unionAll(unnumbered.mapInArrow(remove, schema)).withColumn("carried", named)


def _cleaned(part: pa.RecordBatch, window: int, phrase: int, keep_layout: bool) -> pa.RecordBatch:
    shard = Shard(part.column("text"), window, phrase)
    at, value, _ = shard.candidates(part.column("recurring"), checked=False)
    firsts = part.column("firsts").cast(pa.large_list(pa.int64()))
    mine = np.repeat(np.arange(len(firsts)), np.asarray(firsts.value_lengths().fill_null(0)))
    owned = firsts.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    known = _numbered(np.concatenate([value, owned]), np.concatenate([shard.row[at], mine]))
    # a window stays where its document is the first to have it, at its first place there
    here = pd.Series(known[: len(at)])
    stays = (~here.duplicated() & here.isin(known[len(at) :])).to_numpy(dtype=bool)
    n = len(shard.starts)
    edge = np.zeros(n + 1, dtype=np.int64)
    gone = at[~stays]
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + window, -1)
    kept = np.cumsum(edge[:n]) == 0
    sums = np.concatenate([[0], np.cumsum(~kept)])
    removed_n = sums[shard.first[1:]] - sums[shard.first[:-1]]
    texts, runs = [], []
    for r in range(len(removed_n)):
        a, b = shard.first[r], shard.first[r + 1]
        raw = shard.data[shard.ends[r] : shard.ends[r + 1]].tobytes()
        if not removed_n[r]:
            runs.append([])
            texts.append(raw.decode() if keep_layout else b" ".join(raw.split()).decode())
            continue
        mask = kept[a:b]
        flips = np.flatnonzero(np.diff(np.concatenate([[0], (~mask).astype(np.int8), [0]])))
        pairs = flips.reshape(-1, 2)
        runs.append([{"first": int(x), "words": int(y - x)} for x, y in pairs])
        if keep_layout:
            begins = shard.starts[a:b] - shard.ends[r]
            pieces, last = [], 0
            for x, y in pairs:
                pieces.append(raw[last : begins[x]])
                last = begins[y] if y < b - a else len(raw)
            texts.append(b"".join([*pieces, raw[last:]]).decode())
        else:
            texts.append(b" ".join(compress(raw.split(), mask)).decode())
    return pa.record_batch(
        [
            part.column("doc_id"),
            pa.array(np.diff(shard.first)),
            pa.array(removed_n),
            pa.array(runs, type=pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))),
            pa.array(texts, type=pa.string()),
        ],
        names=["doc_id", "n_words", "n_removed", "removed", "text"],
    )
