"""Hard negatives by exact search of k-means inverted lists.

Every vector lies in the list of its nearest centroid, and a list keeps its radius: the largest distance of a
vector to the centroid. For a query q and a list of centroid c and radius r, no inner product in the list is over
``q.c + |q| r`` or under ``q.c - |q| r`` (Cauchy-Schwarz). A query visits lists from the highest upper bound down,
passes over those whose bounds lie outside of its window, and stops where the bound falls strictly below the
k-th score it has. In Spark that is two rounds: a few lists first, which give a k-th score, and then all
that are still open by it. Queries go to lists, in blocks; lists are cut into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.llm.scratch import saved

LEAST, MOST = -(1 << 62), 1 << 62
#: Products worked on at a time in a task.
BLOCK = 2_000_000
WINDOWS = "array<struct<slot:int,low:bigint,high:bigint,floor:bigint>>"


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def complete(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


@dataclass(frozen=True)
class Shape:
    """What is known of all vectors: rows, components, the largest magnitude, and how many bytes a stored component has."""

    rows: int
    size: int
    most: int

    @property
    def stored(self) -> np.dtype:
        return np.dtype("<i2" if self.most < 1 << 15 else "<i4" if self.most < 1 << 31 else "<i8")

    @property
    def worked(self) -> np.dtype:
        """A type in which inner products are exact."""
        largest = self.size * self.most * self.most
        if largest >= 1 << 62:
            raise ValueError("inner products of these vectors don't fit 64 bits")
        return np.dtype(np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64)

    def matrix(self, stored: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(stored), dtype=self.stored).reshape(len(stored), self.size)


@dataclass(frozen=True)
class Lists:
    """Centroids, and the radius and number of parts of each list (0: it is empty)."""

    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of inner products, queries x lists, rounding allowed for."""
        dot, reach = q @ self.centroids.T, np.linalg.norm(q, axis=1)[:, None] * self.radius
        slack = 1e-9 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(self.centroids, axis=1) + reach) + 1e-6
        return dot - reach - slack, dot + reach + slack


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T), axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids of a sample; a centroid that loses all its vectors stays where it is."""
    rng = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    centroids = different[np.sort(rng.choice(len(different), size=min(k, len(different)), replace=False))].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, centroids)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centroids)) for j in range(x.shape[1])], axis=1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _stored(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, label and vector as bytes; a vector with fewer components than the longest has zeros behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = batch.column("ints")
            sizes = ints.value_lengths().to_numpy(zero_copy_only=False)
            values = ints.flatten().to_numpy(zero_copy_only=False)
            held = np.zeros((len(sizes), shape.size), dtype=shape.stored)
            held[np.arange(shape.size)[None, :] < sizes[:, None]] = values
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array([v.tobytes() for v in held], pa.binary())], names=["id", "label", "vector"])

    return run


def _assigned(shape: Shape, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shape.matrix(batch.column("vector").to_pylist()).astype(np.float64)
            own = nearest(x, centroids)
            away = np.linalg.norm(x - centroids[own], axis=1)
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(away), *(batch.column(c) for c in ("id", "label", "vector"))], names=["list", "away", "id", "label", "vector"])

    return run


@dataclass(frozen=True)
class Index:
    """Rows in lists (list, part, id, label, vector), and what is known of the lists."""

    rows: DataFrame
    lists: Lists
    shape: Shape


def build_index(rows: DataFrame, most_lists: int = 1024, sample_rows: int = 20_000, part_rows: int = 50_000) -> Index | None:
    """Index all ``rows`` (id, label: long, ints: array of long); None if there are none.

    Centroids, half the square root of the number of rows and ``most_lists`` at most, are fitted on about
    ``sample_rows`` rows taken by a hash of id; every row is indexed. A list of over ``part_rows`` rows is
    cut into parts by a hash of id.
    """
    n, size, most = rows.agg(F.count("*"), F.max(F.size("ints")), F.max(F.array_max(F.transform("ints", F.abs)))).first()
    if not n:
        return None
    shape = Shape(n, max(size, 1), most or 0)
    vectors = rows.mapInArrow(_stored(shape), "id long, label long, vector binary")
    share = int(1_000_000_000 * min(1.0, sample_rows / n))
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < share).orderBy(F.xxhash64("id"), "vector").limit(2 * sample_rows).select("vector").toPandas()
    x = shape.matrix(sample["vector"].tolist()) if len(sample) else np.zeros((1, shape.size), dtype=shape.stored)
    centroids = k_means(x, max(1, min(most_lists, int(n**0.5) // 2)))
    assigned = saved(vectors.mapInArrow(_assigned(shape, centroids), "list int, away double, id long, label long, vector binary"), "inverted-lists")
    known = assigned.groupBy("list").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    radius, parts = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for r in known.collect():  # a row for each list, most_lists at most
        radius[r["list"]], parts[r["list"]] = r["radius"] * (1 + 1e-9), r["parts"]
    of_list = rows.sparkSession.createDataFrame([(k, int(p)) for k, p in enumerate(parts)], "list int, parts int")
    cut = assigned.join(F.broadcast(of_list), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "label", "vector")
    return Index(cut, Lists(centroids, radius, parts), shape)


def open_lists(lists: Lists, q: np.ndarray, windows: list[list[dict]], first: int, rest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Query and list of each visit.

    Lists that may hold a score inside of any window are visited from the highest upper bound down: the
    ``first`` ones, or with ``rest`` those behind them whose bound isn't below the floors.
    """
    low, high = lists.bounds(q)
    inside, above = np.zeros(low.shape, dtype=bool), np.zeros(low.shape, dtype=bool)
    for j in range(max((len(w) for w in windows), default=0)):
        has = [i for i, w in enumerate(windows) if len(w) > j]
        lo, hi, floor = (np.array([windows[i][j][c] for i in has], dtype=np.float64)[:, None] for c in ("low", "high", "floor"))
        inside[has] |= (high[has] >= lo) & (low[has] <= hi)
        above[has] |= (high[has] >= floor) & (low[has] <= hi)
    inside &= lists.parts > 0
    order = np.argsort(np.where(inside, -high, np.inf), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    return np.nonzero(inside & above & (place >= first) if rest else inside & (place < first))


def _routed(index: Index, first: int, rest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row of a query for every part of every list that it visits."""
    lists, shape = index.lists, index.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q = shape.matrix(batch.column("vector").to_pylist()).astype(np.float64)
                query, visited = open_lists(lists, q, batch.column("windows").to_pylist(), first, rest)
                n = lists.parts[visited]
                part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                own = batch.take(pa.array(np.repeat(query, n)))
                yield pa.record_batch([pa.array(np.repeat(visited, n).astype(np.int32)), pa.array(part.astype(np.int32)), *own.columns], names=["list", "part", *batch.schema.names])

    return run


class Part:
    """Vectors of a part of a list in order of id; exact repeats count once."""

    def __init__(self, rows: list[pa.RecordBatch], shape: Shape):
        ids, labels = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("id", "label"))
        stored = [v for r in rows for v in r.column("vector").to_pylist()]
        order = np.lexsort((labels, ids))
        if len(np.unique(ids)) < len(ids):
            seen: set[tuple] = set()
            order = np.array([i for i in order.tolist() if (t := (ids[i], labels[i], stored[i])) not in seen and not seen.add(t)])
        self.ids, self.labels, self.shape = ids[order], labels[order], shape
        self.matrix = shape.matrix([stored[i] for i in order.tolist()]).astype(shape.worked)

    def best(self, queries: pa.RecordBatch, same: bool, k: int) -> Iterator[pa.RecordBatch]:
        """For each query and window the ``k`` best of this part between floor and high: (anchor_id, key, slot, id, score)."""
        step = max(1, BLOCK // len(self.ids))
        for at in range(0, queries.num_rows, step):
            part = queries.slice(at, step)
            anchor, key, label = (part.column(c).to_numpy() for c in ("id", "key", "label"))
            windows = part.column("windows").to_pylist()
            scores = self.shape.matrix(part.column("vector").to_pylist()).astype(self.shape.worked) @ self.matrix.T
            fits = (self.labels == label[:, None]) == same
            if same:
                fits &= self.ids != anchor[:, None]
            for j in range(max((len(w) for w in windows), default=0)):
                bounds = np.array([[w[j]["slot"], max(w[j]["floor"], w[j]["low"]), w[j]["high"]] if len(w) > j else [0, MOST, LEAST] for w in windows], dtype=np.int64)
                row, column = np.nonzero(fits & (scores >= bounds[:, 1:2]) & (scores <= bounds[:, 2:3]))
                row, column, score = top(row, column, scores[row, column].astype(np.int64), k)
                yield pa.record_batch([pa.array(anchor[row]), pa.array(key[row]), pa.array(bounds[row, 0].astype(np.int32)), pa.array(self.ids[column]), pa.array(score)], names=["anchor_id", "key", "slot", "id", "score"])


def top(row: np.ndarray, column: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` entries of greatest score of each row, of equal scores the lesser columns; entries come in order of row and column."""
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    begins = np.searchsorted(row, row)
    keep = np.arange(len(row)) - begins < k
    return row[keep], column[keep], score[keep]


def _visited(shape: Shape, same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads parts one after the other: the rows of a part (kind 0), which are held, and then its queries, as many as there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, part = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in ("list", "part", "kind")], axis=1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                here, piece = (int(place[a, 0]), int(place[a, 1])), batch.slice(a, b - a)
                if place[a, 2] == 0:
                    if here != current:
                        current, rows, part = here, [], None
                    rows.append(piece)
                elif here == current:  # else the part has no rows
                    part = part or Part(rows, shape)
                    rows = []
                    yield from part.best(piece, same, k)

    return run


def search(index: Index, asked: DataFrame, same: bool, k: int, first: int = 4) -> DataFrame:
    """The ``k`` best rows of each window of each query, exactly: anchor_id, key, slot, id, score, rank.

    ``asked`` has id, key, label, vector and windows (slot, low, high; floor as low). ``same`` searches among
    rows of the query's label with another id, else among rows of other labels. Greater scores come first, ties by lesser id.
    """
    spark = asked.sparkSession
    n_parts = max(int(index.lists.parts.sum()), int(spark.conf.get("spark.sql.shuffle.partitions")))
    best_first = Window.partitionBy("anchor_id", "key", "slot").orderBy(F.desc("score"), "id")
    best = lambda found: found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)

    def visit(queries: DataFrame, rest: bool) -> DataFrame:
        routed = queries.mapInArrow(_routed(index, first, rest), f"list int, part int, id long, key long, label long, vector binary, windows {WINDOWS}")
        rows = index.rows.select("list", "part", F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("key"), "label", "vector", F.lit(None).cast(WINDOWS).alias("windows"))
        both = rows.unionAll(routed.select("list", "part", F.lit(1).alias("kind"), "id", "key", "label", "vector", "windows"))
        dealt = both.repartition(n_parts, "list", "part").sortWithinPartitions("list", "part", "kind")
        return best(dealt.mapInArrow(_visited(index.shape, same, k), "anchor_id long, key long, slot int, id long, score long"))

    seen = saved(visit(asked, rest=False), "first-lists")
    reached = seen.where(F.col("rank") == k).groupBy("anchor_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
    raised = asked.join(reached, (F.col("id") == F.col("anchor_id")) & (asked["key"] == reached["key"]), "left").select(
        "id", asked["key"], "label", "vector", F.transform("windows", lambda w: w.withField("floor", F.greatest(w["low"], F.coalesce(F.try_element_at("reached", w["slot"]), w["low"])))).alias("windows")
    )
    return best(seen.drop("rank").unionAll(visit(raised, rest=True).drop("rank")))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **options: int) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` picks: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; vectors are taken as floor(256 x). An anchor's positives are its
    ``positives`` best other rows of its label by inner product. For each, the ``negatives`` best rows of other
    labels are returned whose score is from ``low`` to ``high`` percent of the positive's; ties go by lesser vec_id.
    A negative positive score leaves no such window. All is exact, whatever the lists are.

    Rows with a null vec_id, label or vector, or a component that is null or not finite, take no part. A shorter
    vector counts as if zeros followed. Exact repeats of a row count once; rows that share a vec_id but differ are rows
    of their own, and none is the other's positive. Other columns are ignored, whatever their names; an empty
    table gives no rows. Inner products that could pass 2^62 end the job with an error. ``options`` go to ``build_index``.
    """
    spark = rows.sparkSession
    plain = rows.where(rows["vec_id"].isNotNull() & rows["label"].isNotNull() & complete(rows["embedding"]))
    ints = plain.select(plain["vec_id"].cast("long").alias("id"), plain["label"].cast("long").alias("label"), whole_numbers(plain["embedding"]).alias("ints"))
    index = build_index(ints, **options)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    picked = index.rows.withColumn("vec_id", F.col("id")).where(anchors).select("id", F.xxhash64("id", "label", "vector").alias("key"), "label", "vector").distinct()
    one = F.array(F.struct(F.lit(0).alias("slot"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"), F.lit(LEAST).alias("floor")))
    asked = saved(picked.withColumn("windows", one.cast(WINDOWS)), "anchors")
    found = saved(search(index, asked, same=True, k=positives).where(F.col("score") >= 0), "positives")
    window = F.struct(F.col("rank").cast("int").alias("slot"), F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high"), F.expr(f"({low} * score + 99) div 100").alias("floor"))
    windows = found.groupBy(F.col("anchor_id").alias("of_id"), F.col("key").alias("of_key")).agg(F.collect_list(window).cast(WINDOWS).alias("windows"))
    again = asked.drop("windows").join(windows, (F.col("id") == F.col("of_id")) & (F.col("key") == F.col("of_key"))).select("id", "key", "label", "vector", "windows")
    hard = search(index, again, same=False, k=negatives).select("anchor_id", "key", "slot", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    of = found.select("anchor_id", "key", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(of, ["anchor_id", "key", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
