"""Document quality by gradient-boosted trees over text statistics.

Trees are grown on histograms of the statistics and then flattened into arrays (feature, bin, children,
value), which numpy walks for all rows and all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.arrow_text import run_hashes, scramble, shingle_hashes, sized_slices, utf8, words
from leafspark.llm.labelled import remainder, training_rows

BLOCK = 48
FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "marks", "exclamations", "symbols", "wide", "new_words", "same_as_last",
    "new_phrases", "lines", "block_upper", "block_symbols", "block_exclamations", "block_same", "block_new",
)


def _flags(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars if isinstance(chars, bytes) else chars.encode())] = True
    return out


_UPPER, _DIGIT = _flags(bytes(range(65, 91))), _flags("0123456789")
_MARKS, _CRY, _SYMBOL = _flags(".,;:!?'\"-()"), _flags("!"), _flags("#*$%&|<>@^~_=+{}[]\\/")


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; a text without words has zeros."""
    data, ends = utf8(texts)
    starts, stops, first = words(data, ends)
    n_rows, n = len(ends) - 1, len(starts)
    out = np.zeros((n_rows, len(FEATURES)))
    if not n:
        return out
    counts = np.diff(first)
    row = np.repeat(np.arange(n_rows), counts)
    held = counts > 0
    size = np.maximum(np.diff(ends), 1)

    def in_words(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[data])])
        return sums[stops] - sums[starts]

    by_row = lambda x: np.bincount(row, weights=x, minlength=n_rows)
    h = run_hashes(data, starts, stops)
    upper, cry, symbol = in_words(_UPPER), in_words(_CRY), in_words(_SYMBOL)
    length = stops - starts
    fresh = ~pd.Series(h ^ scramble(row.astype(np.uint64))).duplicated().to_numpy()
    same = np.zeros(n, dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    n_words = np.maximum(counts, 1)
    columns = {
        "log_words": np.log1p(counts),
        "word_bytes": by_row(length) / n_words,
        "upper": by_row(upper) / size,
        "digits": by_row(in_words(_DIGIT)) / size,
        "marks": by_row(in_words(_MARKS)) / size,
        "exclamations": by_row(cry) / size,
        "symbols": by_row(symbol) / size,
        "wide": by_row(in_words(~_flags(bytes(range(128))))) / size,
        "new_words": by_row(fresh) / n_words,
        "same_as_last": by_row(same) / n_words,
        "new_phrases": np.ones(n_rows),
        "lines": np.bincount(np.clip(np.searchsorted(ends, np.flatnonzero(data == 10), side="right") - 1, 0, n_rows - 1), minlength=n_rows) / n_words,
    }
    phrases = shingle_hashes(h, 3)
    if len(phrases):
        whole = row[: len(phrases)] == row[2:]
        keys = pd.Series((phrases ^ scramble(row[: len(phrases)].astype(np.uint64)))[whole])
        new = np.bincount(row[: len(phrases)][whole], weights=~keys.duplicated().to_numpy(), minlength=n_rows)
        columns["new_phrases"] = np.where(counts >= 3, new / np.maximum(counts - 2, 1), 1.0)
    place = np.arange(n) - first[:-1][row]
    begins = np.flatnonzero(place % BLOCK == 0)
    block_row = row[begins]
    block_words = np.diff(np.append(begins, n))
    block_bytes = np.add.reduceat(length, begins)
    for name, x, per in (("block_upper", upper, block_bytes), ("block_symbols", symbol, block_bytes), ("block_exclamations", cry, block_bytes), ("block_same", same, block_words), ("block_new", ~fresh, block_words)):
        share = np.where(block_words >= min(8, BLOCK), np.add.reduceat(x.astype(np.int64), begins) / per, 0)
        best = np.zeros(n_rows)
        np.maximum.at(best, block_row, share)
        columns[name] = best
    for k, name in enumerate(FEATURES):
        out[held, k] = columns[name][held]
    return out


@dataclass
class Forest:
    """Trees flattened into arrays: node 0 is the first tree's root; a leaf's children are itself."""

    edges: np.ndarray  # feature x (bins - 1)
    roots: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        bins = self.binned(x)
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(bins[rows, self.feature[node]] <= self.bin[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Forest:
    """Grow trees on histograms of gradients. Without rows of both labels the score is constant."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    edges = np.stack([np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]) for k in range(len(FEATURES))]) if len(y) else np.zeros((len(FEATURES), bins - 1))
    nodes: dict[str, list] = {k: [] for k in ("feature", "bin", "left", "right", "value")}
    forest = Forest(edges, *(np.zeros(0, dtype=int) for _ in range(5)), np.zeros(0), base, depth)
    if len(y) < 2 * least or y.min() == y.max():
        return forest
    b = forest.binned(x).astype(np.int64)
    flat = b + np.arange(len(FEATURES)) * bins
    raw = np.full(len(y), base)
    roots = []

    def add(value: float) -> int:
        for k, v in (("feature", 0), ("bin", bins), ("left", len(nodes["value"])), ("right", len(nodes["value"])), ("value", value)):
            nodes[k].append(v)
        return len(nodes["value"]) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        root = add(0.0)
        roots.append(root)
        todo = [(root, np.arange(len(y)), 0)]
        while todo:
            node, rows, level = todo.pop()
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                keys = flat[rows].ravel()
                weigh = lambda w: np.bincount(keys, weights=np.repeat(w, len(FEATURES)), minlength=len(FEATURES) * bins).reshape(len(FEATURES), bins).cumsum(axis=1)[:, :-1]
                lg, lh, ln = weigh(g[rows]), weigh(h[rows]), weigh(np.ones(len(rows)))
                gain = lg**2 / (lh + ridge) + (sum_g - lg) ** 2 / (sum_h - lh + ridge) - sum_g**2 / (sum_h + ridge)
                gain[(ln < least) | (len(rows) - ln < least)] = -1
                k = int(gain.argmax())
                best = (gain.flat[k], divmod(k, bins - 1))
            if best[1] is None or best[0] <= 1e-6:
                nodes["value"][node] = rate * sum_g / (sum_h + ridge)
                raw[rows] += nodes["value"][node]
                continue
            f, cut = best[1]
            goes_left = b[rows, f] <= cut
            nodes["feature"][node], nodes["bin"][node] = f, cut
            nodes["left"][node], nodes["right"][node] = add(0.0), add(0.0)
            todo += [(nodes["left"][node], rows[goes_left], level + 1), (nodes["right"][node], rows[~goes_left], level + 1)]
    return Forest(edges, np.array(roots), *(np.array(nodes[k]) for k in ("feature", "bin", "left", "right")), np.array(nodes["value"], dtype=float), base, depth)


def _list_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sized_slices(batch, "text"):
            x = statistics(part.column("text"))
            yield pa.record_batch([part.column("label"), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["label", *FEATURES])


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Forest:
    """Fit on at most ``most_rows`` labelled texts, of any length, whose crc32 remainder by 5 isn't 0; only their statistics come to the driver."""
    sample = training_rows(docs, labels, "quality", 5, 0, most_rows)
    rows = sample.mapInArrow(_list_statistics, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    rows = rows.sort_values(list(rows.columns))  # the order of arrival decides nothing
    return fit(rows[list(FEATURES)].to_numpy(dtype=float).reshape(-1, len(FEATURES)), rows["label"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """Score every text: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts have the statistics of an empty one and are scored like others; a null doc_id
    stays null; repeated rows are scored each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(forest.score(statistics(part.column("text"))))], names=["doc_id", "held_out", "score"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (remainder(doc_id, 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
