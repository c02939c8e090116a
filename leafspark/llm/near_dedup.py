"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch is filled in rounds: in each of the first ``COORDINATES`` rounds every shingle is thrown into one
bin, in later rounds into a bin set beforehand, so every coordinate fills; a bin keeps its least value, and
a value of an earlier round beats all later ones. A document stops as soon as its bins are full, so the
work is about the number of its shingles. Two sketches agree in a coordinate with a probability equal to
the sets' similarity.

Documents of equal shingle sets are one node. Nodes that agree in a band of coordinates share a bucket;
no bucket's pairs are listed. Each member is held against its buckets' pivots and hubs, its best partner
is verified on full sets, and what is linked is merged. Only buckets that still hold several components
are compared further, in blocks: sketches alone are sent to blocks, where members are sought that are alike
enough to one of another component, in the first band that the two share; sets follow only for these, and
every link is confirmed on full sets. A set is its shingles' 64-bit hashes: two documents of n shingles
together have a clash among them with a chance of n * n / 2**65 (3e-8 for a million), which moves the share by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.arrow_text import lower_ascii, run_hashes, scramble, shingle_hashes, sized_slices, utf8, words
from leafspark.llm.components import components
from leafspark.llm.scratch import Scratch

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Members of a block, and shingles of them all, of which two blocks are held at once.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Sketches this far below the threshold (over five standard deviations) aren't verified.
MARGIN = 0.19
_FULL = np.uint64(2**64 - 1)
_SALTS = np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the texts' limits in them.

    Words are lowered in A-Z. A text of fewer than ``size`` words has its whole sequence as one shingle;
    a text without words has none.
    """
    data, ends = utf8(texts)
    data = lower_ascii(data)
    starts, stops, first = words(data, ends)
    h = run_hashes(data, starts, stops)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = shingle_hashes(h, size)
    inside = np.arange(len(whole)) + size <= np.repeat(first[1:], counts)[: len(whole)]
    rows, values = [row[: len(whole)][inside]], [whole[inside]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            values.append(scramble(shingle_hashes(h, n)[first[short]] ^ np.uint64(n)))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(len(counts) + 1))


def sketches(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of each set, as 16-bit values (rows x COORDINATES); an empty set's is zero."""
    t, n = COORDINATES, len(limits) - 1
    bins = np.full(n * t, _FULL, dtype=np.uint64)
    row = np.repeat(np.arange(n), np.diff(limits))
    for i in range(2 * t):
        if not len(row):
            break
        thrown = scramble(values + _SALTS[i])
        bin_ = (thrown & np.uint64(t - 1)).astype(np.int64) if i < t else i - t
        np.minimum.at(bins, row * t + bin_, (np.uint64(i) << np.uint64(56)) | (thrown >> np.uint64(8)))
        if i < 8 or i % 8 == 7:
            full = (bins.reshape(n, t) != _FULL).all(axis=1)
            keep = ~full[row]
            row, values = row[keep], values[keep]
    out = (scramble(bins) >> np.uint64(48)).astype("<u2").reshape(n, t)
    out[np.diff(limits) == 0] = 0
    return out


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text", 1_000_000):
                values, limits = shingle_sets(part.column("text"), size)
                counts = np.diff(limits)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(scramble(values ^ np.uint64(salt)))]) for salt in (1, 2)]
                keys = [(s[limits[1:]] - s[limits[:-1]]).view(np.int64) for s in sums]
                held = sketches(values, limits).tobytes()
                width = 2 * COORDINATES
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(counts.astype(np.int64)), *map(pa.array, keys), pa.array([held[i : i + width] for i in range(0, len(held), width)], type=pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "sketch"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, "text", 1_000_000):
                values, limits = shingle_sets(part.column("text"), size)
                raw, ends = values.tobytes(), (8 * limits).tolist()
                full = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch([part.column("doc_id"), pa.array(full, type=pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i, (a, b) in enumerate(zip(batch.column("set_u"), batch.column("set_v"), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
                shared = _common(a, b)
                linked[i] = 100 * shared >= percent * (len(a) + len(b) - shared)
            yield pa.record_batch([batch.column("u"), batch.column("v"), pa.array(linked)], names=["u", "v", "linked"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v, linked of every pair, decided on the full sets. Many pairs may share a v; the join splits them."""
    with_u = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("set_u")), "u")
    with_v = with_u.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("set_v")), "v")
    return with_v.select("u", "v", "set_u", "set_v").mapInArrow(_confirm(percent), "u long, v long, linked boolean")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal entries of two sorted arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


class _Block:
    """Rows of one bucket's block, or pair of blocks, in which pairs of different components are sought."""

    def __init__(self, rows: pa.Table):
        self.doc, self.comp, self.block = (rows.column(c).to_numpy() for c in ("doc_id", "component", "block"))
        self.band, self.low, self.high = (rows.column(c)[0].as_py() for c in ("band", "low", "high"))
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype="<u2").reshape(-1, COORDINATES)
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def candidates(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components, alike enough, whose first common band is this bucket's; the likest of a few rows first."""
        left = np.arange(len(self.doc)) if self.low == self.high else np.flatnonzero(self.block == self.low)
        right = left if self.low == self.high else np.flatnonzero(self.block == self.high)
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            apart = self.comp[rows][:, None] != self.comp[right][None, :]
            if self.low == self.high:
                apart &= rows[:, None] < right[None, :]
            a, b = np.nonzero(apart)
            for cut in range(0, len(a), 20_000):
                x, y = rows[a[cut : cut + 20_000]], right[b[cut : cut + 20_000]]
                equal = self.sketch[x] == self.sketch[y]
                alike = equal.mean(axis=1)
                first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                take = np.flatnonzero((alike >= least) & (first == self.band))
                take = take[np.argsort(-alike[take], kind="stable")]
                yield x[take], y[take]

    def open_members(self, least: float) -> np.ndarray:
        """Which rows have a candidate partner."""
        out = np.zeros(len(self.doc), dtype=bool)
        for x, y in self.candidates(least):
            out[x] = out[y] = True
        return out

    def links(self, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
        """Links, on full sets, that join components."""
        for xs, ys in self.candidates(percent / 100 - MARGIN):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                a, b = self.root(int(self.comp[x])), self.root(int(self.comp[y]))
                if a == b:
                    continue
                shared, total = _common(sets[x], sets[y]), len(sets[x]) + len(sets[y])
                if 100 * shared >= percent * (total - shared):
                    self.parent[max(a, b)] = min(a, b)
                    u, v = int(self.doc[x]), int(self.doc[y])
                    yield max(u, v), min(u, v)


def _in_groups(work: Callable[[pa.Table], pa.Table]):
    """``work`` on every (bucket, low, high) group of rows; the groups come whole and sorted, one after the other."""

    def limits(table: pa.Table) -> list[int]:
        columns = [table.column(c).to_numpy() for c in ("bucket", "low", "high")]
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.flatnonzero(new).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            begins = limits(table)
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                yield from work(table.slice(a, b - a)).to_batches()
            held = table.slice(begins[-1]).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return run


def _open_members(percent: int):
    def work(rows: pa.Table) -> pa.Table:
        return rows.filter(pa.array(_Block(rows).open_members(percent / 100 - MARGIN)))

    return _in_groups(work)


def _block_links(percent: int):
    def work(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, dtype="<u8") for x in rows.column("shingles").to_pylist()]
        pairs = np.array(list(_Block(rows).links(sets, percent)), dtype=np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return _in_groups(work)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets' intersection is ``percent`` % of their union or more.

    ``docs`` has doc_id and text. Returns doc_id, n_shingles, component_id (the least doc_id reachable
    over links) and kept (doc_id = component_id), for every row.

    A null or empty text, or one without words, has no shingles and is linked with nothing; texts shorter
    than a shingle are one shingle; rows that share a doc_id are one document (repeated rows get the same
    result); a null doc_id takes no part: its component_id is null and it is kept; other columns are
    ignored; an empty table gives no rows. A pair at the threshold shares no band with probability 5e-8;
    no bucket is capped, and no bucket's pairs are listed.
    """
    scratch = Scratch(docs.sparkSession)
    saved = scratch.save
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(rows.mapInArrow(_sign(size), "doc_id long, n_shingles long, k1 long, k2 long, sketch binary"), "sketches")
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = saved(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "equal-sets")
    nodes = full.join(same.withColumnRenamed("node", "doc_id"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])

    keys = F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(sketch, {8 * b + 1}, 8)")) for b in range(BANDS)])
    banded = saved(nodes.select("doc_id", F.posexplode(keys).alias("band", "bucket")), "bands")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.xxhash64("bucket", "doc_id")).alias("lead")).where(F.col("n") > 1)
    members = saved(banded.join(shared, "bucket"), "members").select("doc_id", "band", "bucket", "n", "lead")
    scratch.drop("bands")

    def partners(lead: DataFrame) -> DataFrame:
        """u, v and the number of buckets in which u meets v as the bucket's lead."""
        met = members.select("doc_id", "bucket").join(lead, "bucket").where(F.col("doc_id") != F.col("lead_id"))
        return met.groupBy(F.col("doc_id").alias("u"), F.col("lead_id").alias("v")).agg(F.count("*").alias("met"))

    pivots = members.where(F.xxhash64("bucket", "doc_id") == F.col("lead")).groupBy("bucket").agg(F.min("doc_id").alias("lead_id"))
    by_pivot = saved(partners(pivots), "pivots")
    degree = by_pivot.groupBy(F.col("u").alias("doc_id")).agg(F.sum("met").alias("degree"))
    graded = members.where(F.col("n") > 2).select("doc_id", "bucket").join(degree, "doc_id")
    # the highest degree, the least id of equals; aggregated before the shuffle, so no task has a bucket's rows
    hubs = graded.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("less"))).alias("top")).select("bucket", (-F.col("top.less")).alias("lead_id"))
    best = by_pivot.unionAll(partners(hubs)).groupBy("u").agg(F.max_by("v", F.struct("met", -F.col("v"))).alias("v"))
    first_pairs = saved(best.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "first-pairs")

    wanted = members.select("doc_id").distinct()
    sets = saved(rows.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(size), "doc_id long, shingles binary"), "shingle-sets")
    links = saved(verified(first_pairs, sets, percent).where("linked").select("u", "v"), "links")
    found = saved(components(links), "components")

    placed = members.select("doc_id", "band", "bucket", "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(F.col("a") < F.col("b")).select("bucket")
    opened = saved(placed.join(mixed, "bucket", "left_semi").join(nodes.select("doc_id", "n_shingles").dropDuplicates(["doc_id"]), "doc_id"), "open")
    parts = opened.groupBy("bucket").agg(F.ceil(F.greatest(F.max("n") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sketch = nodes.select("doc_id", "sketch").dropDuplicates(["doc_id"])
    alike = (
        opened.join(parts, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("doc_id", "component", "band", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .join(sketch, "doc_id")
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
    )
    row = "doc_id long, component long, band int, bucket long, block int, low int, high int, sketch binary"
    alike = saved(alike.mapInArrow(_open_members(percent), row), "alike")
    whole = alike.join(sets, "doc_id").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    later = saved(whole.mapInArrow(_block_links(percent), "u long, v long"), "later-links")
    final = saved(components(links.unionAll(later)), "all-components").select("node", "component")

    by_set = same.join(final, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    by_set = saved(by_set, "sets-of-components")
    scratch.keep_only("sketches", "sets-of-components")
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(by_set, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
