import numpy as np
import pytest

from catalograin.llm.vector_join import Layout, choose_pivots, directions, forest, linked, near_vectors

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) from all pairs."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in good:
        for y in good:
            a, b = (np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for v in (np.array(rows[x][1]), np.array(rows[y][1])))
            if x < y and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                n[x] += 1
                n[y] += 1
                up[max(root(x), root(y))] = min(root(x), root(y))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted((repr((rows[k][0], n[k], least[root(k)], rows[k][0] == least[root(k)])) for k in range(len(rows))))


def planted(seed, width, groups, noise, alone):
    """Groups around random directions at several distances, chains between some, exact and scaled copies."""
    rng = np.random.default_rng(seed)
    vectors = list(rng.normal(size=(alone, width)))
    for size in groups:
        middle = rng.normal(size=width)
        middle /= np.linalg.norm(middle)
        spread = rng.choice(noise)
        vectors += [middle + rng.normal(size=width) * spread for _ in range(size)]
        vectors += [vectors[-1] * 3.0, vectors[-1].copy(), vectors[-1].copy()]
        step = rng.normal(size=width) * 0.25 / np.sqrt(width)
        vectors += [middle + k * step for k in range(1, 6)]
    order = rng.permutation(len(vectors))
    return [(int(i), [float(x) for x in vectors[k]]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("width", "alone", "unit_rows"), [(16, 60, 4096), (4, 150, 16), (2, 40, 8)])
def test_against_brute_force(spark, width, alone, unit_rows):
    """Few dimensions make chains through everything; small units make one cell span many tasks."""
    rows = planted(width, width, [3, 40, 90, 12], [0.01, 0.05, 0.3 / np.sqrt(width)], alone)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), unit_rows=unit_rows)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0], [1.0, 0.0], [1e300, 1e299], [1e-300, 1e-301], [1.0, 0.0, 0.0], [0.9, 0.4358898943540674]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(6, [1.0, 0.0]), (None, [0.0, -1.0]), (None, None), (50, [-1.0, 0.2]), (None, [-1.0, 0.2])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'x' AS {c}" for c in "v f1 f2 cls node root weight n unit chunk kept component_id".split()))
    got = near_vectors(docs).collect()
    want = brute(rows)
    assert sorted(repr((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in got) == want
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None)], SCHEMA)).collect() == [(1, 0, 1, True)]


def test_cells_hold_every_partner():
    """Of any two linked vectors, one visits the other's cell, or both are at home in one; never both visit."""
    rng = np.random.default_rng(1)
    radius = np.arccos(0.9)
    for width in (2, 3, 6):
        unit = directions(rng.normal(size=(400, width)))
        pivots = choose_pivots(unit[:200], 12, radius)
        angles = np.arccos(np.clip(unit @ pivots.T, -1, 1))
        nearest = angles.argmin(axis=1)
        at = angles[np.arange(400), nearest]
        cell = 2 * nearest + (at > radius / 2)
        held = [at[cell == c] for c in range(2 * len(pivots))]
        layout = Layout(pivots, *(np.array([f(h) if len(h) else 0 for h in held]) for f in (min, max, len)))
        visits = layout.visits(angles, cell, radius)
        for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9), strict=True):
            assert (cell[i] == cell[j]) != (bool(visits[i, cell[j]]) != bool(visits[j, cell[i]]))
        assert width > 3 or visits.mean() < 0.5


def test_single_precision_decides_nothing_close():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 24))
    b = a[rng.permutation(300)] + rng.normal(size=(300, 24)) * 0.48  # cosines around 0.9
    cos = (a @ b.T) / np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None, :])
    at = float(np.sort(cos.ravel())[-150])
    assert (linked(a, b, at) != (cos >= at)).sum() <= 1  # the pair of that very cosine, by rounding
    assert (linked(a, b, 0.9) == (cos >= 0.9)).all() and 0 < (cos >= 0.9).sum() < 300


def test_forest_has_the_components_of_the_links():
    found = np.zeros((4, 5), bool)
    found[0, 1] = found[1, 1] = found[1, 4] = found[3, 3] = True
    edges = forest(found, np.array([10, 11, 12, 13]), np.array([20, 21, 22, 23, 5]))
    assert sorted(map(tuple, edges.tolist())) == [(10, 5), (11, 5), (21, 5), (23, 13)]
