"""Language identification by fusing evidence on each row.

The likelihood of a text's character trigrams is combined with what its page declares (the language of
its markup), with the suffix of its address, and with a prior of its host. Host priors are counts of the
languages that texts alone speak for, smoothed towards the suffix's shares and these towards the whole
table's; they come from grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafspark.llm.arrow_text import lower_ascii, scramble, sized_slices, utf8
from leafspark.llm.scratch import saved

BUCKETS = 1 << 14
#: Bytes of text scored at once; a task holds some hundred bytes of numbers for each.
SLICE_BYTES = 250_000
#: Priors of so many hosts, an array of as many numbers as languages each, are broadcast; more are joined by a shuffle.
MOST_BROADCAST_HOSTS = 20_000
#: Suffixes of addresses that stand for a language, where another than the language's own code does.
SUFFIX_LANGUAGES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "at": "de", "mx": "es", "ar": "es", "be": "fr"}


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around every letter, their rows, and each row's letters and bytes.

    Letters are a-z after lowering and bytes of non-ASCII characters; anything else is one mark.
    """
    data, ends = utf8(texts)
    data = lower_ascii(data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    kept = np.where(letter, data, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.flatnonzero(letter)
    before, behind = np.full(len(kept), 32, dtype=np.uint32), np.full(len(kept), 32, dtype=np.uint32)
    if len(kept):
        before[1:], behind[:-1] = kept[:-1], kept[1:]
        begin = ends[:-1][np.diff(ends) > 0]
        before[begin] = 32
        behind[begin[1:] - 1] = 32
    code = (before[at] << 16) | (kept[at] << 8) | behind[at]
    bucket = (scramble(code.astype(np.uint64)) >> np.uint64(50)).astype(np.int64)
    rows = row[at]
    return bucket, rows, np.bincount(rows, minlength=len(ends) - 1), np.diff(ends)


@dataclass(frozen=True)
class Model:
    """Log probabilities: a row for each language, and one for text of no known language."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum over each text's trigrams of log probability (rows x languages and unknown), and its letters."""
        bucket, rows, letters, _ = trigrams(texts)
        out = np.stack([np.bincount(rows, weights=lp[bucket], minlength=len(texts)) for lp in self.log_p], axis=1)
        return out.astype(np.float64), letters


def of_counts(names: tuple[str, ...], counts: np.ndarray, smooth: float = 0.2) -> Model:
    """Trigram shares of each language; the unknown language spreads evenly over half of the buckets."""
    known = counts + smooth
    return Model(names, np.concatenate([np.log(known / known.sum(axis=1, keepdims=True)), np.full((1, BUCKETS), np.log(2 / BUCKETS))]))


def fit(texts: list[str], languages: list[str]) -> Model:
    """A model of the given texts."""
    names = tuple(sorted(set(languages)))
    own = [pa.array([t for t, x in zip(texts, languages, strict=True) if x == name], type=pa.large_string()) for name in names]
    return of_counts(names, np.array([np.bincount(trigrams(t)[0], minlength=BUCKETS) for t in own]).reshape(-1, BUCKETS))


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sized_slices(batch, "text", SLICE_BYTES):
            bucket, rows, _, _ = trigrams(part.column("text"))
            language, names = pd.factorize(np.array(part.column("language").to_pylist(), dtype=object))
            counts = np.bincount(language[rows] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(names[at // BUCKETS], type=pa.string()), pa.array((at % BUCKETS).astype(np.int32)), pa.array(counts[at])], names=["language", "bucket", "n"])


def fit_languages(docs: DataFrame, language: str = "lang", rows_of_each: int = 1_000) -> Model:
    """Fit on about ``rows_of_each`` whole texts of each language (all, where there are fewer); every language is modelled.

    Rows are taken by a hash of doc_id, at a share of each language's own rows, so a rare language has its
    sample however large the table is. Trigrams are counted by tasks; only counts come to the driver.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(language).cast("string").alias("language"), "text").where(F.col("language").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("language").count().orderBy("language").collect()  # a row for each language
    if not sizes:
        return of_counts((), np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["language"], int(1_000_000_000 * min(1.0, rows_of_each / r["count"])))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) < share[F.col("language")])
    counted = sample.select("language", "text").mapInArrow(_count_trigrams, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(r["language"] for r in sizes))
    counts = np.zeros((len(names), BUCKETS))
    counts[counted["language"].map({n: k for k, n in enumerate(names)}).to_numpy(dtype=np.int64), counted["bucket"].to_numpy(dtype=np.int64)] = counted["n"]
    return of_counts(names, counts)


def address_host(url: Column) -> Column:
    """Host of an address, in lower case, without user, port and a leading www."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.", ""), F.lit(""))


def markup_language(html: Column) -> Column:
    """Primary tag of the language that an html element declares."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))


def suffix_language(host: Column) -> Column:
    """Language that a host's last label stands for, by code or by SUFFIX_LANGUAGES."""
    last = F.element_at(F.split(host, r"\."), -1)
    other = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGES.items() for x in pair])
    return F.coalesce(other[last], last)


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags; one that isn't closed goes on to the page's end."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[a-z/!?][^>]*(?:>|\z)", " ")
    return F.trim(F.regexp_replace(bare, r"&[a-zA-Z#0-9]+;", " "))


def identify(
    rows: DataFrame,
    model: Model,
    keys: list[str],
    temper: float = 0.1,
    declared_right: float = 0.9,
    suffix_right: float = 0.8,
    strength: float = 20.0,
    unknown: float = 1e-4,
    least_share: float = 0.3,
    least_letters: int = 1,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Language of every row of ``rows``: the ``keys``, text, and as far as known declared, suffix and host.

    Returns the keys, language (``und`` if unknown), share (its posterior probability) and kept. A row is
    kept when its language isn't ``und``, its share is ``least_share`` or more and it has ``least_letters``
    letters. ``temper`` weighs a trigram's log probability, as neighbours overlap; ``declared_right`` and
    ``suffix_right`` are the chances that such a hint is right; ``strength`` is how many texts a prior from
    above weighs in a host's or a suffix's shares; ``unknown`` is the prior of no known language.

    Missing hints (null, or of a language not modelled) say nothing; rows without a host share the prior of
    the table. Null and empty texts have no letters and aren't kept. Null keys and repeated rows come back
    each; other columns are ignored; an empty table gives no rows. A model without languages (nothing was
    there to fit it on) tells nothing: all rows are ``und``, and those with letters are kept. The texts are read once, and the scores
    written to the shared folder, from which priors and posteriors are computed in Spark SQL. With ``carry``, the result also has carried, a
    struct of the columns so named; then nothing is written, and texts are scored twice: for the priors, and with their rows.
    A text that is carried goes through Python once, not beside a copy of itself.
    """
    spark = rows.sparkSession
    names = [*model.languages, "und"]
    n = len(names)
    have = set(rows.columns)
    hint = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    others = [c for c in carry if c != "text"]
    rest = [F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("none")).alias("carried")] if carry else []
    source = rows.select(F.struct(*[F.col(k) for k in keys]).alias("key"), "text", hint("declared").alias("declared"), hint("suffix").alias("suffix"), hint("host").alias("host"), *rest)
    shared = spark.sparkContext.broadcast(model)

    def scores_of(own: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sized_slices(batch, "text", SLICE_BYTES):
                    scores, letters = shared.value.likelihoods(part.column("text"))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, n), type=pa.int32()), pa.array(scores.ravel()))
                    yield pa.record_batch([*(part.column(c) for c in columns), lists, pa.array(letters, type=pa.int64())], names=[*columns, "scores", "letters"])

        schema = T.StructType([own.schema[c] for c in columns]).add("scores", T.ArrayType(T.DoubleType())).add("letters", T.LongType())
        return own.mapInArrow(run, schema)

    hints = ("declared", "suffix", "host")
    more = ["carried"] if carry else []
    if carry:
        held = F.struct(*[F.col("text") if c == "text" else F.col("carried").getField(f"c{others.index(c)}").alias(c) for c in carry])
        own = ("text",) if "text" in carry else ()
        scored, again = scores_of(source.select("text", *hints), hints), scores_of(source, ("key", *hints, *own, "carried")).withColumn("carried", held).drop("text")
    else:
        scored = again = saved(scores_of(source, ("key", *hints)), "language-scores")

    if not model.languages:
        return again.select("key.*", *more, F.lit("und").alias("language"), F.lit(1.0).alias("share"), "letters", (F.col("letters") >= least_letters).alias("kept"))

    best = F.array_position(F.slice("scores", 1, n - 1), F.array_max(F.slice("scores", 1, n - 1))).cast("int") - 1
    votes = scored.where((F.col("letters") >= least_letters) & (F.array_max(F.slice("scores", 1, n - 1)) > F.element_at("scores", -1))).select("host", "suffix", best.alias("best"))
    tally = [F.sum((F.col("best") == k).cast("long")).alias(f"n{k}") for k in range(n - 1)]
    by_host = votes.groupBy("host", "suffix").agg(*tally)  # one row for each host, whatever its size
    by_suffix = by_host.groupBy("suffix").agg(*[F.sum(f"n{k}").alias(f"s{k}") for k in range(n - 1)])
    whole = votes.agg(*[F.coalesce(t, F.lit(0)) for t in tally]).first()  # one count for each language

    def shares(prefix: str, parents: list[Column]) -> list[Column]:
        total = sum((F.coalesce(F.col(f"{prefix}{k}"), F.lit(0)) for k in range(n - 1)), F.lit(0))
        return [(F.coalesce(F.col(f"{prefix}{k}"), F.lit(0)) + strength * parents[k]) / (total + strength) for k in range(n - 1)]

    top = [F.lit((whole[k] + strength / (n - 1)) / (sum(whole) + strength)) for k in range(n - 1)]
    suffix_shares = by_suffix.select(F.col("suffix").alias("suffix_key"), *[c.alias(f"p{k}") for k, c in enumerate(shares("s", top))])
    priors = by_host.join(suffix_shares, F.col("suffix").eqNullSafe(F.col("suffix_key"))).select(
        F.col("host").alias("host_key"),
        F.col("suffix").alias("of_suffix"),
        F.array(*[F.log(c) for c in shares("n", [F.col(f"p{k}") for k in range(n - 1)])]).alias("prior"),
    )
    joined = again.join(F.broadcast(priors) if carry and priors.count() <= MOST_BROADCAST_HOSTS else priors, F.col("host").eqNullSafe(F.col("host_key")) & F.col("suffix").eqNullSafe(F.col("of_suffix")), "left")
    modelled = F.array(*[F.lit(x) for x in model.languages])

    def says(column: str, right: float) -> Column:
        """Log of how likely the hint is under each language; 0 where it says nothing."""
        c = F.col(column)
        wrong = float(np.log((1 - right) / max(n - 2, 1)))
        spoken = F.transform(modelled, lambda x: F.when(x == c, F.lit(float(np.log(right)))).otherwise(F.lit(wrong)))
        return F.when(F.array_contains(modelled, c), spoken).otherwise(F.array_repeat(F.lit(0.0), n - 1))

    even = F.array_repeat(F.lit(float(-np.log(max(n - 1, 1)))), n - 1)
    evidence = F.zip_with(F.zip_with(F.coalesce("prior", even), says("declared", declared_right), lambda a, b: a + b), says("suffix", suffix_right), lambda a, b: a + b)
    fused = joined.select("key", *more, "letters", F.zip_with(F.concat(evidence, F.array(F.lit(float(np.log(unknown))))), F.transform("scores", lambda x: x * temper), lambda a, b: a + b).alias("fused"))
    peak = fused.withColumn("peak", F.array_max("fused"))
    weighed = peak.withColumn("share", 1 / F.aggregate(F.transform("fused", lambda x: F.exp(x - F.col("peak"))), F.lit(0.0), lambda a, x: a + x))
    found = weighed.withColumn("language", F.when(F.col("letters") == 0, "und").otherwise(F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("fused", F.col("peak")).cast("int"))))
    kept = (F.col("language") != "und") & (F.col("share") >= least_share) & (F.col("letters") >= least_letters)
    return found.select("key.*", *more, "language", "share", "letters", kept.alias("kept"))
