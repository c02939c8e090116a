"""Hard negatives against brute force: nulls, ties, repeats, vectors of other lengths, many small lists and parts."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspark.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id string, key int, score string, slot int, list int"


def table(spark, rows):
    return spark.createDataFrame([(v, x, e, "i", 1, "s", 2, 3) for v, x, e in rows], SCHEMA)


def brute_force(rows, positives=5, negatives=3):
    good = []
    for v, label, e in rows:
        if v is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = (v, label, tuple(math.floor(256 * float(np.float32(x))) for x in e))
        if row not in good:
            good.append(row)
    out = []
    for a, label, x in good:
        if a % 5:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), v, other == label) for v, other, y in good]  # noqa: B905
        for s, p, _ in sorted(t for t in scored if t[2] and t[1] != a)[:positives]:
            fits = sorted((t, n) for t, n, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def corpus(seed, n=300, size=6, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(8)]
    rows = []
    for v in range(n):
        c = rng.choice(centres)
        rows.append((v, rng.randrange(labels), [x + rng.gauss(0, 0.3) for x in c]))
    same = [0.5] * size
    rows += [(n + i, i % 3, same) for i in range(60)]  # ties
    rows += [rows[3], rows[3], rows[5], (10, 1, [0.1] * size), (15, 2, [0.9, -0.2])]  # repeats, an id of two rows, a short vector
    return rows + [(1000, None, same), (1005, 1, None), (1010, 1, [None] * size), (1015, 1, [math.nan] * size), (1020, 1, [math.inf] * size), (None, 1, same), (1025, 2, []), (1030, 9, same)]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"part_rows": 7}), (3, {"most_lists": 1}), (4, {"sample_rows": 20})])
def test_mine_equals_brute_force(spark, seed, options):
    rows = corpus(seed)
    found = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0, **options).collect()
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = sorted(tuple(r[c] for c in columns) for r in found)
    assert got == brute_force(rows) and len(got) > 100


def test_nothing_to_mine(spark):
    assert hard_negatives.mine(table(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives.mine(table(spark, [(0, 1, None)]), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives.mine(table(spark, [(0, 1, [1.0]), (1, 2, [1.0])]), F.col("vec_id") % 5 == 0).collect() == []


def test_bounds_hold_and_lists_out_of_reach_are_passed_over():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.01, (50, 8)) for c in (-1, 0, 1)]))
    centroids = hard_negatives.k_means(x[[0, 1, 50, 51, 100, 101]], 6)[[0, 2, 4]]
    own = hard_negatives.nearest(x, centroids)
    radius = np.array([np.linalg.norm(x[own == k] - centroids[k], axis=1).max() for k in range(3)])
    lists = hard_negatives.Lists(centroids, radius, np.ones(3, dtype=np.int64))
    low, high = lists.bounds(x)
    dots = x @ x.T
    for k in range(3):
        assert (dots[:, own == k] <= high[:, k : k + 1]).all() and (dots[:, own == k] >= low[:, k : k + 1]).all()
    q = x[-1:]
    window = {"slot": 0, "low": hard_negatives.LEAST, "high": hard_negatives.MOST, "floor": hard_negatives.LEAST}
    _, first = hard_negatives.open_lists(lists, q, [[window]], 1, rest=False)
    assert first.tolist() == [own[-1]]
    kth = int(np.sort(dots[-1, own == own[-1]])[-5])
    assert hard_negatives.open_lists(lists, q, [[window | {"floor": kth}]], 1, rest=True)[1].tolist() == []
    assert len(hard_negatives.open_lists(lists, q, [[window]], 1, rest=True)[1]) == 2
    near_zero = {"slot": 0, "low": -9000, "high": 9000, "floor": -9000}
    assert hard_negatives.open_lists(lists, q, [[near_zero]], 9, rest=False)[1].tolist() == [own[75]]


def test_types_in_which_products_are_exact():
    for most, size, kind in ((256, 64, np.float32), (5000, 64, np.float64), (40_000_000, 64, np.int64)):
        shape = hard_negatives.Shape(1, size, most)
        x = np.full((1, size), most, dtype=shape.stored).astype(shape.worked)
        assert shape.worked == kind and int((x @ x.T)[0, 0]) == size * most * most
    with pytest.raises(ValueError):
        _ = hard_negatives.Shape(1, 64, 1 << 40).worked
