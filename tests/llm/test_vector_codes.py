import hashlib
import math
import random

import numpy as np
import pytest

from catalograin.llm.vector_codes import KdTree, compressed, encode, fit


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops over (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(mine[k]) for col in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, labels[label], sha) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def vectors(n, width, seed, coarse=False):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 1), 1 if coarse else 6) / (4 if coarse else 1) for _ in range(width)], rng.choice([None, 1, 2, 2, 2])) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("coarse", [False, True])
@pytest.mark.parametrize(("n", "width", "parts", "entries"), [(150, 32, 16, 64), (90, 8, 2, 20), (5, 16, 16, 64)])
def test_against_brute_force(spark, n, width, parts, entries, coarse):
    """Coarse components make many equal distances."""
    rows = vectors(n, width, n, coarse)
    bad = [(-3, None, 1), (-2, [float("nan")] * width, 1), (-1, [None] + [0.0] * (width - 1), 1), (1000, [float("inf")] * width, None)]
    got = compressed(spark.createDataFrame(rows + bad, SCHEMA).repartition(5), parts, entries)
    assert sorted(map(tuple, got.collect())) == brute(rows + bad, parts, entries)


def test_tree_takes_the_lower_of_equals():
    rng = np.random.default_rng(3)
    for entries in (rng.integers(-3, 4, (64, 3)), np.zeros((40, 3), np.int64), rng.integers(-2, 3, (200, 1))):
        points = rng.integers(-5, 6, (500, entries.shape[1]))
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        best, distance = KdTree(entries).nearest(points)
        assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_huge_components_are_exact(spark):
    rows = [(i, [s * 1e30, -1e-30, 3e9 * i, 0.5], None) for i, s in enumerate([1.0, -1.0, 1.0, 0.25])] + [(9, [1e300, -1e300, 5e8, 0.0], 1)]
    got = sorted(map(tuple, compressed(spark.createDataFrame(rows, SCHEMA).repartition(3), 2, 3).collect()))
    want = brute(rows, 2, 3)
    assert [(i, code, sha) for i, code, _, _, sha in got] == [(i, code, sha) for i, code, _, _, sha in want]
    assert [e for _, _, e, _, _ in got] == [e if e < 2**63 else None for _, _, e, _, _ in want]
    floats = spark.createDataFrame([(1, [3e38, 0.0], 1), (2, [-3e38, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [r["error"] for r in compressed(floats, 1, 2).collect()] == [0, 0]


def test_edges(spark):
    rows = [(1, [0.5, 0.25], None), (1, [0.5, 0.25], None), (None, [0.75, 0.25], 1), (2, [1.0] * 4, 1), (3, [1.0] * 3, 1), (4, [], 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "'x' AS error", "'x' AS v", "'x' AS label_error")
    got = compressed(docs, 2, 2).collect()
    # both entries start equal; all take the lower, its mean moves away, and the equal ones then have the other to themselves
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == [(0, "0000", 0, 0), (1, "0100", 0, 0), (1, "0100", 0, 0)]
    none = spark.createDataFrame([], SCHEMA)
    assert compressed(none).count() == 0 and encode(none, fit(none)).count() == 0
    assert compressed(spark.createDataFrame([(1, None, 3)], SCHEMA)).count() == 0
