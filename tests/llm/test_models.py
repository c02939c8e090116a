"""Fitted operators: gradients, held-out accuracy, and odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafspark.llm import labelled, language, quality_model, toxicity

SF_DIR = "/root/testdata/sf0.01"
ODD = [(None, "some words"), (9001, None), (9002, ""), (9003, " \n\t"), (9004, "x" * 30_000), (9005, "word " * 20_000), (9006, "same"), (9006, "same")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, 1, 2, "n") for d, t in ODD], "doc_id long, text string, score int, label int, key string")


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.new_network(np.arange(5, dtype=np.uint64))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, ids, y = rng.normal(size=(7, 16)), rng.integers(0, 7, (4, toxicity.WINDOW)), np.array([0, 1, 0, 1.0])
    _, g, dx = toxicity.gradients(p, ids, y, x)
    for k in ("Uf", "Ub", "Wf", "Wb", "bf", "bb", "a", "o", "c"):
        direction = rng.normal(size=p[k].shape)
        step = [toxicity.gradients(p | {k: p[k] + e * direction}, ids, y, x)[0] for e in (1e-3, -1e-3)]
        assert np.isclose((step[0] - step[1]) / 2e-3, (g[k] * direction).sum(), rtol=0.02, atol=2e-4), k
    direction = rng.normal(size=x.shape)
    step = [toxicity.gradients(p, ids, y, x + e * direction)[0] for e in (1e-3, -1e-3)]
    assert np.isclose((step[0] - step[1]) / 2e-3, (dx * direction).sum(), rtol=0.02, atol=2e-4)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 200, 1000):
        ids, row = toxicity.windows(np.array([0, n]), np.arange(n), n)
        assert set(ids.ravel().tolist()) - {n} == set(range(n)) and (row == 0).all() and len(row) >= 1


def test_both_ways_of_scoring_agree():
    """The batched inference equals the loss function's forward pass."""
    rng = np.random.default_rng(1)
    net = toxicity.new_network(np.arange(5, dtype=np.uint64))
    x, ids = rng.normal(size=(9, 16)).astype(np.float32), rng.integers(0, 9, (3, toxicity.WINDOW))
    logits = net.logits(ids, x)
    for i in range(3):
        loss, _, _ = toxicity.gradients(net.p, ids[i : i + 1], np.array([1.0]), x)
        assert np.isclose(loss, np.logaddexp(0, -logits[i]), atol=1e-4)


def test_toxic_words_anywhere_in_a_long_text():
    rng = random.Random(4)
    clean = [f"{a}{b}" for a in "bcdfg" for b in ("ata", "elo", "iru", "omi", "une")]
    bad = ["zoggle", "grimph"]
    text = lambda n: " ".join(rng.choice(clean) for _ in range(n)).split()
    texts, labels = [], []
    for k in range(400):
        w = text(rng.randint(10, 120))
        if k % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append(int(k % 4 == 0))
    net = toxicity.fit(texts, np.array(labels), rounds=3, epochs=3)
    hidden = text(1500)
    for at in (3, 700, 1498):
        hidden[at : at + 2] = bad
    s = net.scores(pa.array([" ".join(text(1500)), " ".join(hidden), "", None, " ".join(text(5))]))
    assert s[1] >= 0.3 and s[0] < 0.3 and s[4] < 0.3 and ((0 <= s) & (s <= 1)).all()


def test_toxicity_of_odd_rows(spark, odd):
    net = toxicity.fit(["a b", "c d"], np.array([0, 0]))  # one label only
    rows = toxicity.score_toxicity(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert toxicity.score_toxicity(odd.limit(0), net).count() == 0
    assert len(toxicity.fit([], np.zeros(0, dtype=int)).scores(pa.array(["x"]))) == 1


def accuracy(spark, scored, label):
    y = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = scored.where("held_out").join(y, "doc_id").toPandas()
    order = rows["score"].rank()
    ones = rows["y"] == 1
    auc = (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / max(ones.sum() * (~ones).sum(), 1)
    return auc, len(rows)


def test_toxicity_on_held_out_rows(spark):
    """Some 300 labelled texts, 37 of them toxic: of the 14 held-out toxic ones, nine have a word that marks them."""
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).persist()
    auc, n = accuracy(spark, scored, "toxic")
    caught = scored.where("held_out AND predicted = 1").join(labels, "doc_id").agg(F.sum("toxic"), F.count("*")).first()
    scored.unpersist()
    assert n > 80 and auc > 0.85 and caught[0] >= 8 and caught[0] >= 0.7 * caught[1]


def long_and_short(spark, marked, plain, column):
    """Labelled texts of which only long ones carry the label, with more long texts of either kind, not labelled."""
    rng = random.Random(11)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(d, text(plain, 30), 0) for d in range(200)] + [(d, text(marked if d % 2 else plain, 45_000), d % 2) for d in range(200, 240)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], f"doc_id long, {column} int")
    return docs, labels, {d: y for d, _, y in rows}


def test_long_texts_are_learned_from(spark):
    plain, marked = [f"{a}{b}" for a in "bcdfg" for b in ("ata", "elo", "iru", "omi")], ["zoggle", "grimph", "bata", "celo", "AAAA!!", "$$$$"]
    docs, labels, truth = long_and_short(spark, marked, plain, "toxic")
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] >= 200) >= 38
    docs, labels, truth = long_and_short(spark, marked, plain, "quality")
    got = quality_model.score_quality(docs, quality_model.fit_quality(docs, labels)).collect()
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] >= 200) >= 38


def test_windows_of_long_texts_are_chosen_from_all_of_it(spark):
    texts = [" ".join(f"w{i}" for i in range(50_000)), "short text", None]
    marked = texts[0].replace("w33333 ", "marked ")
    rows = [(1, 1, marked), (2, 0, texts[1]), (3, 0, "w1 w2 w3"), (4, 1, "marked words"), (5, 1, "so marked")]
    odds = toxicity.word_odds(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    for text in (marked, texts[0]):
        out = toxicity.excerpts(pa.array([text, *texts[1:]]), odds, 4096).to_pylist()
        assert out[1:] == texts[1:]
        words = out[0].split()
        at = [int(x[1:]) for x in words if x != "marked"]
        assert 4000 <= len(words) <= 4096 and min(at) < 1000 and max(at) > 49_000 and ("marked" in words) == (text is marked)
    by_word = dict(zip(odds[0].tolist(), odds[1].tolist(), strict=True))
    mark, common = (by_word[int(toxicity.read_words(pa.array([w])).hashes[0])] for w in ("marked", "w2"))
    prior = 4 / 7
    assert np.isclose(mark, np.log((3 + 2 * prior) / (2 * (1 - prior))) - np.log(prior / (1 - prior)), atol=1e-5) and np.isclose(common, np.log((1 + 2 * prior) / (1 + 2 * (1 - prior))) - np.log(prior / (1 - prior)), atol=1e-5)


def test_scores_are_those_of_the_worst_window():
    rng = np.random.default_rng(3)
    net = toxicity.new_network(np.zeros(0, dtype=np.uint64))
    net.p["C"] = rng.normal(size=net.p["C"].shape).astype(np.float32)
    texts = [" ".join(f"a{rng.integers(90)}" for _ in range(n)) for n in (5, 32, 33, 100, 47)] + ["", None]
    got = net.scores(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        words = (text or "").split()
        begins = sorted({min(k * toxicity.STRIDE, max(len(words) - toxicity.WINDOW, 0)) for k in range(1 + max(0, -(-(len(words) - toxicity.WINDOW) // toxicity.STRIDE)))})
        each = [net.scores(pa.array([" ".join(words[b : b + toxicity.WINDOW])]))[0] for b in begins]
        assert np.isclose(score, max(each), atol=1e-6)


def test_a_network_is_what_its_formulas_say():
    """One window, one step after the other, in plain numpy of 64 bits."""
    net = toxicity.new_network(np.zeros(0, dtype=np.uint64), seed=5)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text = "some words of a window"
    w = toxicity.read_words(pa.array([text]))
    _, _, x = net.inputs(w)
    x = np.stack([*(x[i].astype(np.float64) for i in w.order), *([x[-1].astype(np.float64)] * (toxicity.WINDOW - len(w.order)))])
    sigmoid, h, states = lambda v: 1 / (1 + np.exp(-v)), p["Uf"].shape[0], [[], []]
    for k, d in enumerate("fb"):
        state = np.zeros(h)
        for t in range(toxicity.WINDOW) if k == 0 else range(toxicity.WINDOW - 1, -1, -1):
            g, u = x[t] @ p["W" + d] + p["b" + d], state @ p["U" + d]
            z, r = sigmoid(g[:h] + u[:h]), sigmoid(g[h : 2 * h] + u[h : 2 * h])
            state = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * state
            states[k].append(state)
    both = np.concatenate([np.array(states[0]), np.array(states[1])[::-1]], axis=1)
    weigh = np.exp(both @ p["a"])
    assert np.isclose(net.scores(pa.array([text]))[0], sigmoid((both @ p["o"] * weigh).sum() / weigh.sum() + p["c"][0]), atol=1e-5)


def test_every_language_is_modelled(spark):
    rng = np.random.default_rng(1)
    letters = lambda k, n: " ".join("".join(chr(97 + (k + c) % 26) + chr(97 + k // 10) for c in rng.integers(0, 3, 4)) for _ in range(n))
    rows = [(3 * k + i, letters(k, 40), f"l{k:03}") for k in range(230) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs)
    assert len(model.languages) == 230


def plain_languages(rows, model, temper=0.1, declared_right=0.9, suffix_right=0.8, strength=20.0, unknown=1e-4):
    """Likelihoods, hints and host priors, one row after the other."""
    n = len(model.languages)
    likely, letters = model.likelihoods(pa.array([r["text"] for r in rows]))
    votes = [int(np.argmax(s[:n])) if k and max(s[:n]) > s[n] else None for s, k in zip(likely, letters, strict=True)]
    tally = lambda keep: np.array([sum(v == k and keep(r) for v, r in zip(votes, rows, strict=True)) for k in range(n)], dtype=float)
    smooth = lambda counts, parent: (counts + strength * parent) / (counts.sum() + strength)
    whole = smooth(tally(lambda r: True), np.full(n, 1 / n))
    out = []
    for r, s, k in zip(rows, likely, letters, strict=True):
        host = tally(lambda x: (x["host"], x["suffix"]) == (r["host"], r["suffix"]))  # noqa: B023
        prior = smooth(host, smooth(tally(lambda x: x["suffix"] == r["suffix"]), whole)) if host.sum() else np.full(n, 1 / n)  # noqa: B023
        score = np.log(np.append(prior, unknown)) + temper * s
        for hint, right in ((r["declared"], declared_right), (r["suffix"], suffix_right)):
            if hint in model.languages:
                score[:n] += [np.log(right) if x == hint else np.log((1 - right) / max(n - 1, 1)) for x in model.languages]
        share = np.exp(score - score.max())
        best = int(np.argmax(score))
        name = "und" if not k or best == n else model.languages[best]
        out.append((r["id"], name, round(1 / share.sum(), 6), name != "und" and 1 / share.sum() >= 0.3))
    return out


def test_language_of_pages_equals_plain_fusion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit_languages(docs)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    rng = np.random.default_rng(2)
    rows = [{"id": i, "text": (t or "")[: int(rng.integers(0, 120))], "declared": [None, "de", "en", "xx"][i % 4], "suffix": [None, "fr", "es"][i % 3], "host": [None, "a", "b"][i % 5 % 3], "kept": 1} for i, t in enumerate(texts)]
    rows += [{**rows[0], "id": 90, "text": None}, {**rows[0], "id": None, "text": "1 2 3"}, rows[7]]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, text string, declared string, suffix string, host string, kept int")
    want = sorted(plain_languages(rows, model), key=repr)
    for more in ({}, {"carry": ("kept", "text")}):
        found = language.identify(frame, model, ["id"], **more)
        assert sorted(((r["id"], r["language"], round(r["share"], 6), r["kept"]) for r in found.collect()), key=repr) == want
    assert {tuple(r) for r in found.select("id", "carried.text", "carried.kept").collect()} == {(r["id"], r["text"], 1) for r in rows}
    monkey = language.MOST_BROADCAST_HOSTS
    language.MOST_BROADCAST_HOSTS = -1
    try:
        found = language.identify(frame, model, ["id"], carry=("text",))
        assert sorted(((r["id"], r["language"], round(r["share"], 6), r["kept"]) for r in found.collect()), key=repr) == want
    finally:
        language.MOST_BROADCAST_HOSTS = monkey


def test_language_of_pages_query(spark):
    from leafspark.llm import queries

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = queries.op7_language_of_pages(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["page_id"] for r in found) == sorted(r["page_id"] for r in pages.collect())
    assert {"en", "de", "fr", "es"} >= {r["language"] for r in found} - {"und"}



def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    auc, n = accuracy(spark, quality_model.score_quality(docs, quality_model.fit_quality(docs, labels)), "quality")
    assert n > 50 and auc > 0.95


def test_quality_of_odd_rows(spark, odd):
    forest = quality_model.fit(np.zeros((0, len(quality_model.FEATURES))), np.zeros(0))
    rows = quality_model.score_quality(odd, forest).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_model.score_quality(odd.limit(0), forest).count() == 0


def test_flat_trees_learn_and_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    f = quality_model.fit(x, y, trees=30)
    assert ((f.score(x) >= 0.5) == (y == 1)).mean() > 0.95
    bins = f.binned(x[:20])
    for i in range(20):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if bins[i, f.feature[node]] <= f.bin[node] else f.right[node]
            total += f.value[node]
        assert np.isclose(total, f.raw(x[i : i + 1])[0])


def test_statistics_of_parts():
    s = dict(zip(quality_model.FEATURES, quality_model.statistics(pa.array(["AB cd cd!", None, ""]))[0], strict=True))
    assert s["upper"] == 2 / 9 and s["exclamations"] == 1 / 9 and s["word_bytes"] == 7 / 3 and s["new_words"] == 1
    alone = quality_model.statistics(pa.array(["a a b"]))
    among = quality_model.statistics(pa.array(["a", "a a b", "b b"]))
    assert np.allclose(alone[0], among[1])


def test_language_on_rows_not_fitted_on(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language.fit_languages(docs.where("doc_id % 2 = 0"))
    found = language.identify(docs.where("doc_id % 2 = 1").select("doc_id", "text", F.col("source").alias("host")), model, ["doc_id"])
    right = found.join(docs.select("doc_id", "lang"), "doc_id").select(F.avg((F.col("language") == F.col("lang")).cast("int")), F.avg(F.col("kept").cast("int"))).first()
    assert right[0] > 0.97 and right[1] > 0.99


def test_rare_languages_have_a_sample(spark):
    rows = [(d, "the and of that with", "en") for d in range(3000)] + [(d, "der und die nicht mit", "de") for d in range(3000, 3003)] + [(None, None, "fr"), (1, "x", None)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_of_each=100)
    assert model.languages == ("de", "en")
    scores, _ = model.likelihoods(pa.array(["der und", "the and"]))
    assert scores.argmax(axis=1).tolist() == [0, 1]
    assert language.fit_languages(spark.createDataFrame(rows[-2:], "doc_id long, text string, lang string")).languages == ()


def test_language_evidence(spark):
    model = language.fit(["the and of that with"] * 5 + ["der und die nicht mit"] * 5, ["en"] * 5 + ["de"] * 5)
    rows = [
        (1, "the and of that", None, None, "a", 7), (2, "der und die nicht", None, None, "b", 7), (3, "", None, None, "a", 7), (4, None, "de", "de", "b", 7), (5, "the", "de", "de", "b", 7),
        (6, "12 34 ++", None, None, None, 7), (None, "der und die", "de", None, "b", 7), (2, "der und die nicht", None, None, "b", 7), (8, "x", None, None, None, 7),
    ]
    rows += [(100 + i, "der und die nicht mit", None, None, "german.example", 7) for i in range(60)] + [(200, "t", None, None, "german.example", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string, scores int")
    out = language.identify(frame, model, ["doc_id"]).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    assert got[1]["language"] == "en" and got[2]["language"] == "de" and got[None]["language"] == "de"
    assert all(got[d]["language"] == "und" and not got[d]["kept"] for d in (3, 4, 6))
    assert got[5]["language"] == "de"  # two hints outweigh one short word
    assert got[200]["language"] == "de"  # so does a host of one language
    assert language.identify(frame.limit(0), model, ["doc_id"]).count() == 0


def test_page_hints(spark):
    html = "<!DOCTYPE html><HTML class=x lang='fr-CA'><script>var a='<p>';</script><p>Bon&nbsp;jour</p><!-- c --></html>"
    row = spark.createDataFrame([("http://www.User.Example.co.uk:80/a?b=//c", html), ("nothing", "<p>x"), (None, None)], "url string, html string")
    host = language.address_host(F.col("url"))
    got = row.select(host, language.suffix_language(host), language.markup_language(F.col("html")), language.visible_text(F.col("html"))).collect()
    assert list(got[0]) == ["user.example.co.uk", "en", "fr", "Bon jour"]
    assert list(got[1]) == [None, None, None, "x"] and list(got[2]) == [None] * 4
    odd = [("a < b<script>x</scr ", "a < b"), ("<p>a<!-- b", "a"), ("x<style>y</style z><b>c", "x"), ("<script>" * 20_000 + "z", ""), ("<" * 50_000, "<" * 50_000)]
    texts = spark.createDataFrame(odd, "html string, text string").select(language.visible_text(F.col("html")).alias("got"), "text").collect()
    assert all(r["got"] == r["text"] for r in texts)


def test_samples_are_bounded(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"))
    assert labelled.at_most(rows, 6000).count() == 5000 and 700 < labelled.at_most(rows, 1000).count() <= 1000
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"))
    assert labelled.at_most(same, 100).count() <= 100


def test_training_rows_leave_out_what_is_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    ids = {r["doc_id"] for r in labelled.training_rows(docs, labels, "toxic", 4, 2, 10_000).collect()}
    assert ids and not any(zlib.crc32(str(d).encode()) % 4 == 2 for d in ids)
