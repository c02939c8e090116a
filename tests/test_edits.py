"""Edits of keyed tables: limits, ids in a circle, deletions, and many tables at once."""

from __future__ import annotations

import random

from leafspark.operators import edits


def plain(rows, asked, first_id):
    """One edit after the other on plain lists."""
    tables, next_ids, out = {}, {}, []
    for k, name, size, own in rows:
        tables.setdefault(k, []).append((name, size, own))
    for k, n, name, size, position in asked:
        t, next_id = tables.setdefault(k, []), next_ids.get(k, first_id)
        t.sort(key=lambda r: r[0].lower().encode())
        if position is not None:
            if 0 <= position < len(t):
                out.append((k, n, 0, t[position][2], position))
                del t[position]
            else:
                out.append((k, n, edits.REJECTED, None, None))
            continue
        if not name or len(name) > 31 or len(t) >= 4096 or any(r[0].lower() == name.lower() for r in t):
            out.append((k, n, edits.REJECTED, None, None))
            continue
        while any(r[2] == next_id for r in t):
            next_id = next_id % 32767 + 1
        next_ids[k] = next_id % 32767 + 1
        if sum(r[1] for r in t) + size > 32_000:
            out.append((k, n, edits.REJECTED, None, None))
            continue
        t.append((name, size, next_id))
        t.sort(key=lambda r: r[0].lower().encode())
        out.append((k, n, 0, next_id, [r[0] for r in t].index(name)))
    return out, {k: t for k, t in tables.items() if t}


def test_edits_equal_a_plain_fold(spark):
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("aBcDé") for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 32])))
    rows = [("x", "first", 100, 32766), ("x", "Second", 31_000, 1), ("y", "a", 10, 2), ("only", "kept", 5, 9)]
    asked = [(rng.choice("xyz"), n, name(), rng.choice([10, 200, 900]), rng.randint(-1, 40) if rng.random() < 0.2 else None) for n in range(900)] + [("x", 900, None, 5, None), (None, 901, "null key", 5, None)]
    tables = spark.createDataFrame(rows, "k string, name string, bytes int, theme_id int")
    frame = spark.createDataFrame(asked, "k string, n int, name string, bytes int, position int").repartition(7)
    want, after = plain(rows, asked, 32760)
    got = [tuple(r) for r in edits.apply_edits(tables, frame, "k", "n", first_id=32760).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {0, edits.REJECTED} and {1, 32766, 32767} - {w[3] for w in want if w[2] == 0} == {1, 32766} - {w[3] for w in want if w[2] == 0}
    left = edits.apply_edits(tables, frame, "k", "n", after=True, first_id=32760).collect()
    assert sorted((tuple(r) for r in left), key=repr) == sorted(((k, *r, i) for k, t in after.items() for i, r in enumerate(t)), key=repr)
    assert edits.apply_edits(tables.limit(0), frame.limit(0), "k", "n").collect() == []


def test_a_table_takes_so_many_rows():
    state = edits.State()
    assert all(state.insert(f"n{i}", 1)[0] == 0 for i in range(4096))
    assert state.insert("one more", 1) == (edits.REJECTED, None, None)
    assert state.delete(5)[0] == 0 and state.insert("one more", 1)[0] == 0 and state.bytes == 4096
