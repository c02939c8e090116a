"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of its form (known forms only) beside the mean embedding of its
character trigrams. Texts are cut into overlapping windows, all of which are scored; a document has
the score of its worst window. Inside a task the input side of the gates is worked out once for each
different word of a slice, and all windows advance together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafspark.llm.arrow_text import lower_ascii, run_hashes, scramble, sized_slices, utf8, words
from leafspark.llm.labelled import remainder, training_rows
from leafspark.llm.scratch import saved

WINDOW, STRIDE = 32, 16
GRAMS = 4096
CHUNK = 1024
BLANK = re.compile(r"[ \t-\r]+")

def _letters() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[97:123] = out[128:] = True
    return out


_LETTER = _letters()


@dataclass
class Words:
    """Different words of some texts: hash and trigrams of each, and the words of the texts in order."""

    hashes: np.ndarray
    gram_rows: np.ndarray
    grams: np.ndarray
    order: np.ndarray
    first: np.ndarray


def read_words(texts: pa.Array) -> Words:
    """Words in lower case without what isn't a letter at their ends (all of it stays if nothing else is there)."""
    data, ends = utf8(texts)
    starts, stops, first = words(data, ends)
    data = lower_ascii(data)
    at = np.flatnonzero(_LETTER[data])
    if len(at) and len(starts):
        after = np.searchsorted(at, starts)
        head = at[np.minimum(after, len(at) - 1)]
        tail = at[np.maximum(np.searchsorted(at, stops) - 1, 0)] + 1
        has = (after < len(at)) & (head < stops)
        starts, stops = np.where(has, head, starts), np.where(has, tail, stops)
    order, hashes = pd.factorize(run_hashes(data, starts, stops))
    where = np.zeros(len(hashes), dtype=np.int64)
    where[order[::-1]] = np.arange(len(order) - 1, -1, -1)
    a, b = starts[where], stops[where]
    # trigrams over the word between two marks: as many as it has bytes
    lengths = (b - a).astype(np.int32)
    begins = np.cumsum(lengths) - lengths
    rows = np.repeat(np.arange(len(a), dtype=np.int32), lengths)
    grams = np.zeros(len(rows), dtype=np.int32)
    for at in range(0, len(rows), 200_000):  # a few at a time, as their numbers are many times the text
        own = rows[at : at + 200_000]
        inside = np.arange(at, at + len(own)) - begins[own]
        i = inside + a[own]
        before = np.where(inside == 0, 1, data[np.maximum(i - 1, 0)]).astype(np.uint64)
        behind = np.where(inside == lengths[own] - 1, 2, data[np.minimum(i + 1, len(data) - 1)]).astype(np.uint64)
        grams[at : at + len(own)] = scramble((before << np.uint64(16)) | (data[i].astype(np.uint64) << np.uint64(8)) | behind) % np.uint64(GRAMS)
    return Words(hashes.astype(np.uint64), rows, grams, order.astype(np.int32), first)


def windows(first: np.ndarray, order: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of every window (short texts are padded) and each window's row; each row has one at least."""
    counts = np.diff(first)
    each = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    row = np.repeat(np.arange(len(counts)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    begin = np.minimum(nth * STRIDE, np.maximum(counts[row] - WINDOW, 0))
    held = order if len(order) else np.zeros(1, dtype=np.int32)
    ids = np.full((len(row), WINDOW), pad, dtype=np.int32)
    for k in range(WINDOW):
        inside = np.flatnonzero(begin + k < counts[row])
        ids[inside, k] = held[first[:-1][row[inside]] + begin[inside] + k]
    return ids, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters; ``known`` are the sorted hashes of known words, whose embeddings follow that of all others."""

    known: np.ndarray
    p: dict[str, np.ndarray]

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding row, number of trigrams and input vector of each word, with padding as one more word."""
        at = np.searchsorted(self.known, w.hashes)
        found = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == w.hashes) if len(self.known) else np.zeros(len(at), dtype=bool)
        rows = np.append(np.where(found, at + 2, 1), 0)
        n = len(w.hashes) + 1
        counts = np.maximum(np.bincount(w.gram_rows, minlength=n), 1).astype(np.float32)
        size = self.p["C"].shape[1]
        chars = np.stack([np.bincount(w.gram_rows, weights=self.p["C"][w.grams, k], minlength=n) for k in range(size)], axis=1).astype(np.float32) / counts[:, None]
        return rows, counts, np.concatenate([self.p["E"][rows], chars], axis=1)

    def logits(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Logit of every window of word ids, given the words' input vectors."""
        h = self.p["Uf"].shape[0]
        scale = np.repeat(np.array([0.5, 0.5, 1.0], dtype=np.float32), h)  # tanh(x / 2) serves the gates
        gates = [((x @ self.p["W" + d] + self.p["b" + d]) * scale).astype(np.float32) for d in "fb"]
        inner = [np.ascontiguousarray(self.p["U" + d] * scale) for d in "fb"]
        out = np.zeros(len(ids), dtype=np.float32)
        for at in range(0, len(ids), CHUNK):
            part = np.ascontiguousarray(ids[at : at + CHUNK].T)
            states = np.empty((WINDOW, part.shape[1], 2 * h), dtype=np.float32)
            for k in range(2):
                state = np.zeros((part.shape[1], h), dtype=np.float32)
                for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                    g = gates[k][part[t]]
                    u = state @ inner[k]
                    zr = np.tanh(g[:, : 2 * h] + u[:, : 2 * h])
                    zr *= 0.5
                    zr += 0.5
                    new = np.tanh(g[:, 2 * h :] + zr[:, h:] * u[:, 2 * h :])
                    state = new + zr[:, :h] * (state - new)
                    states[t, :, k * h : (k + 1) * h] = state
            weigh = states @ self.p["a"]
            weigh = np.exp(weigh - weigh.max(axis=0))
            weigh /= weigh.sum(axis=0)
            out[at : at + CHUNK] = ((states @ self.p["o"]) * weigh).sum(axis=0) + self.p["c"][0]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        w = read_words(texts)
        _, _, x = self.inputs(w)
        ids, row = windows(w.first, w.order, len(w.hashes))
        worst = np.full(len(texts), -np.inf, dtype=np.float32)
        np.maximum.at(worst, row, self.logits(ids, x))
        return 1 / (1 + np.exp(-worst.astype(np.float64)))


def new_network(known: np.ndarray, seed: int = 7, size: int = 8, hidden: int = 8) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"E": 0.1 * rng.normal(size=(len(known) + 2, size)).astype(np.float32), "C": 0.1 * rng.normal(size=(GRAMS, size)).astype(np.float32)}
    p["E"][0] = 0
    for d in "fb":
        p |= {"W" + d: draw(2 * size, 3 * hidden), "U" + d: draw(hidden, 3 * hidden), "b" + d: np.zeros(3 * hidden, dtype=np.float32)}
    return Network(known, p | {"a": draw(2 * hidden), "o": draw(2 * hidden), "c": np.full(1, -2, dtype=np.float32)})


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean logistic loss of windows, and its gradients by the recurrent parameters and the word inputs."""
    h, n = p["Uf"].shape[0], len(ids)
    states = np.zeros((WINDOW, n, 2 * h), dtype=np.float32)
    trace: dict[tuple[str, int], tuple] = {}
    for k, d in enumerate("fb"):
        g_all = (x @ p["W" + d] + p["b" + d])[ids]
        state = np.zeros((n, h), dtype=np.float32)
        for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
            u = state @ p["U" + d]
            zr = _sigmoid(g_all[:, t, : 2 * h] + u[:, : 2 * h])
            new = np.tanh(g_all[:, t, 2 * h :] + zr[:, h:] * u[:, 2 * h :])
            trace[d, t] = (state, zr, new, u[:, 2 * h :])
            state = new + zr[:, :h] * (state - new)
            states[t, :, k * h : (k + 1) * h] = state
    weigh = states @ p["a"]
    weigh = np.exp(weigh - weigh.max(axis=0))
    weigh /= weigh.sum(axis=0)
    each = states @ p["o"]
    logit = (each * weigh).sum(axis=0) + p["c"][0]
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    dl = ((_sigmoid(logit) - y) / n).astype(np.float32)
    d_weigh = weigh * (each - (each * weigh).sum(axis=0)) * dl
    g = {"c": np.array([dl.sum()]), "o": np.einsum("tn,tnh->h", weigh * dl, states), "a": np.einsum("tn,tnh->h", d_weigh, states)}
    d_states = (weigh * dl)[:, :, None] * p["o"] + d_weigh[:, :, None] * p["a"]
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        du, dg_all = np.zeros_like(p["U" + d]), np.zeros((n, WINDOW, 3 * h), dtype=np.float32)
        back = np.zeros((n, h), dtype=np.float32)
        for t in range(WINDOW - 1, -1, -1) if k == 0 else range(WINDOW):
            state, zr, new, un = trace[d, t]
            z, r = zr[:, :h], zr[:, h:]
            dh = back + d_states[t, :, k * h : (k + 1) * h]
            d_new = dh * (1 - z) * (1 - new * new)
            d_zr = np.concatenate([dh * (state - new), d_new * un], axis=1) * zr * (1 - zr)
            d_u = np.concatenate([d_zr, d_new * r], axis=1)
            dg_all[:, t] = np.concatenate([d_zr, d_new], axis=1)
            du += state.T @ d_u
            back = dh * z + d_u @ p["U" + d].T
        flat = dg_all.reshape(-1, 3 * h)
        by_word = np.stack([np.bincount(ids.ravel(), weights=flat[:, j], minlength=len(x)) for j in range(3 * h)], axis=1).astype(np.float32)
        g |= {"U" + d: du, "b" + d: flat.sum(axis=0), "W" + d: x.T @ by_word}
        dx += by_word @ p["W" + d].T
    return loss, g, dx


def summed(rows: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the vectors of each row number."""
    return np.stack([np.bincount(rows, weights=x[:, k], minlength=n) for k in range(x.shape[1])], axis=1)


def evidence(word: np.ndarray, row: np.ndarray, labels: np.ndarray, n: int, weight: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` words, the number of texts that hold it, and the log odds, against the labels' prior, that such a text is toxic.

    ``word`` stands in the text ``row``, and each pair counts once; odds are smoothed by ``weight`` texts.
    """
    pairs = np.unique(word.astype(np.int64) * max(len(labels), 1) + row)
    word, toxic = pairs // max(len(labels), 1), labels[pairs % max(len(labels), 1)] == 1
    prior = (labels.sum() + 1) / (len(labels) + 2)
    yes, no = np.bincount(word[toxic], minlength=n), np.bincount(word[~toxic], minlength=n)
    return yes + no, np.log((yes + weight * prior) / (no + weight * (1 - prior))) - np.log(prior / (1 - prior))


def rolled_max(value: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Greatest value of each window's words."""
    out = value[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        np.maximum(out, value[ids[:, k]], out=out)
    return out


def fit(texts: list[str], labels: np.ndarray, seed: int = 7, rounds: int = 4, epochs: int = 3, most_words: int = 30_000, least_steps: int = 240, rate: float = 0.01, fade: tuple[float, float] = (0.3, 0.05)) -> Network:
    """Train on texts of which only the documents are labelled; known words are those of three texts and a 500th at least.

    A known word's embedding begins with the log odds of the texts that hold it. The
    first round takes the windows whose words have the highest; later rounds take, of each toxic document,
    the windows that the network finds worst, and of each other document the worst and some at random. A
    round has ``least_steps`` / ``rounds`` steps at least, so that few texts are gone through more often.
    Without texts of both labels the network is untrained and its score near the labels' prior.
    """
    rng = np.random.default_rng(seed)
    w = read_words(pa.array(texts, type=pa.large_string()))
    in_texts, odds = evidence(w.order, np.repeat(np.arange(len(texts)), np.diff(w.first)), labels, len(w.hashes))
    often = np.lexsort((w.hashes, -in_texts))[:most_words]
    often = often[in_texts[often] >= max(3, len(texts) // 500)]
    often = often[np.argsort(w.hashes[often])]
    net = new_network(w.hashes[often], seed)
    gram_begins = np.searchsorted(w.gram_rows, np.arange(len(w.hashes) + 1))
    prior = (labels.sum() + 1) / (len(labels) + 2)
    net.p["c"][:] = np.log(prior / (1 - prior))
    if not len(labels) or labels.min() == labels.max():
        return net
    net.p["E"][2:, 0] = 0.5 * odds[often]
    ids, row = windows(w.first, w.order, len(w.hashes))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, decay = 0, dict(zip("EC", fade, strict=True))
    score = rolled_max(np.append(odds, -np.inf).astype(np.float32), ids)
    for turn in range(rounds):
        if turn:
            score = net.logits(ids, net.inputs(w)[2])
        rank = pd.Series(-score).groupby(row).rank(method="first").to_numpy()
        chance = rng.random(len(row))
        toxic = labels[row] == 1
        take = np.flatnonzero(np.where(toxic, rank <= (2, 2, 2, 1)[min(turn, 3)], (rank <= 2) | (chance < 0.15)))
        size_of_batch = min(max(len(take) // 24, 32), 256)  # few windows still make enough steps
        steps = -(-len(take) // size_of_batch)
        for _ in range(max(epochs if turn else 1, -(-least_steps // (rounds * steps)))):
            rng.shuffle(take)
            for at in range(0, len(take), size_of_batch):
                part = take[at : at + size_of_batch]
                # only the batch's words are worked on
                used, local = np.unique(np.append(ids[part].ravel(), len(w.hashes)), return_inverse=True)
                own = used[:-1]
                n_grams = gram_begins[own + 1] - gram_begins[own]
                gram_rows = np.repeat(np.arange(len(own)), n_grams)
                pick = np.arange(len(gram_rows)) + np.repeat(gram_begins[own] - np.cumsum(n_grams) + n_grams, n_grams)
                small = Words(w.hashes[own], gram_rows, w.grams[pick], w.order, w.first)
                rows, counts, x = net.inputs(small)
                y = labels[row[part]].astype(np.float32)
                _, g, dx = gradients(net.p, local[:-1].reshape(len(part), WINDOW), y, x)
                size = net.p["E"].shape[1]
                g["E"] = summed(rows, dx[:, :size], len(net.p["E"]))
                g["C"] = summed(small.grams, (dx[:, size:] / counts[:, None])[small.gram_rows], GRAMS)
                g["E"][0] = 0
                step += 1
                for k, v in g.items():
                    m, s = moment[k]
                    m += 0.1 * (v - m)
                    s += 0.01 * (v * v - s)
                    if k in decay:  # what few texts have fades
                        net.p[k] *= np.float32(1 - decay[k] * rate)
                    net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def excerpts(texts: pa.Array, odds: tuple[np.ndarray, np.ndarray], most_words: int, chosen: float = 0.5) -> pa.Array:
    """The texts; of those of over ``most_words`` words, so many words in windows taken from all of the text.

    All windows of such a text are scored by ``odds`` (sorted hashes of words, and their log odds); the share ``chosen`` of what is taken
    are those of the greatest score, and the others are drawn from all the rest, at places that hang on the text.
    """
    out = texts.to_pylist()
    hashes, value = odds
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if n <= 2 * most_words - 1:  # a word and a space each
            continue
        w = read_words(texts.slice(i, 1))
        if len(w.order) <= most_words:
            continue
        own = np.zeros(len(w.hashes) + 1, dtype=np.float32)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, w.hashes), len(hashes) - 1)
            own[:-1] = np.where(hashes[at] == w.hashes, value[at], 0)
        ids, _ = windows(w.first, w.order, len(w.hashes))
        score = rolled_max(own, ids)
        best = np.argsort(-score, kind="stable")
        first = int(chosen * most_words) // WINDOW
        rng = np.random.default_rng(zlib.crc32(out[i].encode()))
        rest = rng.choice(best[first:], size=min(most_words // WINDOW - first, len(best) - first), replace=False)
        begins = np.minimum(np.sort(np.concatenate([best[:first], rest])) * STRIDE, len(w.order) - WINDOW)
        listed = [x for x in BLANK.split(out[i]) if x]
        out[i] = " ".join(x for b in begins.tolist() for x in listed[b : b + WINDOW])
    return pa.array(out, type=pa.string())


def word_odds(sample: DataFrame, most_words: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log odds of the ``most_words`` most frequent words of labelled whole texts, counted by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text"):
                w = read_words(part.column("text"))
                pairs = np.unique(np.repeat(np.arange(part.num_rows), np.diff(w.first)) * (len(w.hashes) + 1) + w.order)
                yield pa.record_batch([pa.array(w.hashes[pairs % (len(w.hashes) + 1)].view(np.int64)), part.column("label").take(pa.array(pairs // (len(w.hashes) + 1)))], names=["word", "label"])

    toxic, n = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    prior = (toxic + 1) / (n + 2)
    counted = sample.select("text", "label").mapInArrow(run, "word long, label int").groupBy("word").agg(F.sum("label").alias("yes"), F.count("*").alias("n"))
    held = counted.orderBy(F.desc("n"), "word").limit(most_words).toPandas()
    hashes = held["word"].to_numpy(dtype=np.int64).view(np.uint64)
    yes, no = held["yes"].to_numpy(dtype=np.float64), (held["n"] - held["yes"]).to_numpy(dtype=np.float64)
    odds = np.log((yes + 2 * prior) / (no + 2 * (1 - prior))) - np.log(prior / (1 - prior))
    order = np.argsort(hashes)
    return hashes[order], odds[order].astype(np.float32)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 4_000, most_words: int = 4_096) -> Network:
    """Fit on at most ``most_rows`` labelled texts of any length whose crc32 remainder by 4 isn't 2.

    A text of over ``most_words`` words comes to the driver as so many of its words: windows that tasks choose among all of its windows,
    half of them as those whose words have the greatest odds over all labelled whole texts, so that what its label stands for isn't lost.
    """
    sample = saved(training_rows(docs, labels, "toxic", 4, 2, most_rows), "toxicity-sample")
    spark = docs.sparkSession
    long = sample.where(F.octet_length("text") > 2 * most_words).limit(1).count()
    odds = spark.sparkContext.broadcast(word_odds(sample) if long else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), excerpts(part.column("text"), odds.value, most_words), part.column("label")], names=["doc_id", "text", "label"])

    rows = sample.mapInArrow(run, "doc_id long, text string, label int").toPandas().sort_values(["doc_id", "label", "text"])
    return fit(rows["text"].tolist(), rows["label"].to_numpy(dtype=np.int64))


def score_toxicity(docs: DataFrame, net: Network, threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    With ``carry``, also carried: a struct of the columns so named. A text among them goes through Python once, not beside a copy of itself.

    Null and empty texts are one window of padding; texts of any length are scored to their end; a null
    doc_id stays null; repeated rows are scored each; other columns are ignored; an empty table gives no
    rows. The network is a few hundred kilobytes, bounded by its number of words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text", 250_000):
                out = pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(shared.value.scores(part.column("text")))], names=["doc_id", "held_out", "score"])
                for c in more:
                    out = out.append_column(c, part.column(c))
                yield out

    own = [F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id").cast("long"), 4) == 2).alias("held_out"), "text"]
    others = [c for c in carry if c != "text"]
    more = (["text"] if "text" in carry else []) + (["carried"] if carry else [])
    rows = docs.select(*own, *([F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("none")).alias("carried")] if carry else []))
    schema = T.StructType.fromDDL("doc_id long, held_out boolean, score double")
    for c in more:
        schema = schema.add(c, rows.schema[c].dataType)
    held = F.struct(*[F.col("text") if c == "text" else F.col("carried").getField(f"c{others.index(c)}").alias(c) for c in carry]) if carry else None
    scored = rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return scored.select("doc_id", "held_out", "score", "predicted", *([held.alias("carried")] if carry else []))
