"""Embedding near-duplicates: an exact metric range join of vectors by their angle.

Plan (every step is exact; the angle between directions is a metric, and cosine >= c is angle <= r = arccos(c)):

1. Equal vectors form one class, found by a 128-bit fingerprint; only classes are compared.
2. Pivots are directions of a bounded sample: those with many others of the sample within r/2 first, then those far from
   the others. Each class belongs to the cell of its nearest pivot: the cell's core if within r/2 of it, else its shell. Two
   vectors of a core are linked by the triangle inequality alone, so a large group of near copies costs no comparison.
3. A class visits each further cell that may hold a partner: its angle to the pivot must lie within r of the angles found in the
   cell (triangle inequality), and it must lie within r of the plane between its own pivot and the cell's. Of two
   shells, or two cores, one visits the other.
4. Cells are cut into units of at most some rows, and a unit's visitors into chunks; units of one shell visit each other. A
   task compares a unit with one chunk by a matrix product: in single precision where that decides, else anew in double.
   It returns counts and a forest of its links, in which a core is one node, never pairs.
5. Counts are summed per class, weighted by how often each vector stands; components of the forests give the groups.

Where no pivot tells vectors apart (directions spread evenly over many dimensions have all much the same angle to any pivot),
shells are visited by nearly all, and steps 3 and 4 compare all classes with each other in bounded tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .heavy import join_heavy
from .storage import stored
from .vector_codes import finite

#: Rows of which pivots are chosen, pivots at most, rows of a unit, and rows that make a further pivot worth its visits.
SAMPLE_ROWS, MAX_PIVOTS, UNIT_ROWS, CELL_ROWS = 2_000, 256, 4_096, 8_192
#: A core needs so many rows of the sample.
DENSE_ROWS = 4
#: Room for rounding in bounds on angles, which may only let more through.
_ROOM = 1e-6
#: Rows of a unit whose products with a chunk are held at once.
_SLAB = 512


def scaled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by a power of two of their own, which rounds nothing and lets no square overflow, and their lengths."""
    _, exponents = np.frexp(np.abs(values).max(axis=1))
    rows = np.ldexp(values, -exponents[:, None])
    return rows, np.sqrt((rows * rows).sum(axis=1))


def directions(values: np.ndarray) -> np.ndarray:
    rows, lengths = scaled(values)
    return rows / lengths[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def choose_pivots(sample: np.ndarray, wanted: int, radius: float) -> np.ndarray:
    """Of the sample's directions: middles of dense groups (at most MAX_PIVOTS), then far ones until there are `wanted`."""
    if not len(sample):
        return sample
    near = sample @ sample.T >= math.cos(radius / 2)
    free, chosen = np.ones(len(sample), bool), []
    while len(chosen) < MAX_PIVOTS:
        counts = near[:, free].sum(axis=1)
        best = int(counts.argmax())
        if counts[best] < DENSE_ROWS:
            break
        chosen.append(best)
        free &= ~near[best]
    if not chosen:
        chosen.append(0)
    closest = (sample @ sample[chosen].T).max(axis=1)
    while len(chosen) < min(wanted, MAX_PIVOTS, len(sample)):
        far = int(closest.argmin())
        chosen.append(far)
        closest = np.maximum(closest, sample @ sample[far])
    return sample[chosen]


@dataclass(frozen=True)
class Layout:
    """pivots; per cell (2k is the core of pivot k, 2k + 1 its shell) the least and greatest angle to the pivot, and rows (0: empty)."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def units(self, unit_rows: int) -> np.ndarray:
        return np.maximum(1, -(-self.rows // unit_rows))

    def visits(self, angles: np.ndarray, cell: np.ndarray, radius: float) -> np.ndarray:
        """(rows, cells): whether a row with these angles to the pivots, at home in `cell`, visits a cell."""
        home = cell // 2
        numbers = np.arange(2 * len(self.pivots))
        k = numbers // 2
        to_pivot = angles[:, k]
        found = (self.rows > 0)[None, :] & (to_pivot <= self.high + radius + _ROOM) & (to_pivot >= self.low - radius - _ROOM)
        # the plane between two pivots: what lies beyond it by more than r in angle has no partner at this side
        cosines = np.cos(angles)
        apart = np.linalg.norm(self.pivots[:, None, :] - self.pivots[None, :, :], axis=2)[home]
        beyond = cosines[np.arange(len(angles)), home][:, None] - cosines
        found &= (beyond <= math.sin(min(radius, math.pi / 2)) * apart + _ROOM)[:, k]
        # each pair of cells meets at one side: shells come to cores, and of two alike the nearer in a round comes
        n = len(numbers)
        mine, other = cell[:, None], numbers[None, :]
        shell, other_shell = mine % 2 == 1, other % 2 == 1
        step = (other - mine) % n
        comes = np.where(shell == other_shell, (step > 0) & ((2 * step < n) | ((2 * step == n) & (mine < other))), shell)
        return found & comes


def _angles(pivots: np.ndarray, column: pa.Array) -> np.ndarray:
    return np.arccos(np.clip(directions(_matrix(column)) @ pivots.T, -1, 1))


def _homes(pivots: np.ndarray, radius: float):
    """The columns, cell, and angle to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(pivots, batch.column("v"))
                nearest = angles.argmin(axis=1)
                at = angles[np.arange(len(nearest)), nearest]
                cell = 2 * nearest + (at > radius / 2 - _ROOM)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(at)], [*batch.schema.names, "cell", "angle"])

    return run


def _visits(layout: Layout, radius: float, unit_rows: int):
    """The columns but for cell and salt, with core, unit (the row's own), and to (units that it visits)."""
    counts = layout.units(unit_rows)
    first = np.concatenate([[0], np.cumsum(counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.asarray(batch.column("cell"))
            own = np.asarray(batch.column("salt")) % counts[cell]
            found, to = layout.visits(_angles(layout.pivots, batch.column("v")), cell, radius), []
            for i, mine in enumerate(cell):
                units = [np.arange(first[c], first[c + 1]) for c in np.flatnonzero(found[i])]
                n = counts[mine]
                if mine % 2 and n > 1:  # units of one shell: the nearer in a round comes
                    other = np.arange(n)
                    step = (other - own[i]) % n
                    units.append(first[mine] + np.flatnonzero((step > 0) & ((2 * step < n) | ((2 * step == n) & (own[i] < other)))))
                to.append(np.concatenate(units).astype(np.int32) if units else np.zeros(0, np.int32))
            kept = [batch.column(c) for c in ("cls", "weight", "node", "v")]
            more = [pa.array(cell % 2 == 0), pa.array((first[cell] + own).astype(np.int32)), pa.array(to, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*kept, *more], ["cls", "weight", "node", "v", "core", "unit", "to"])

    return run


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a and b have at least this cosine in double precision."""
    (a, a_length), (b, b_length) = scaled(a), scaled(b)
    left, right = (a / a_length[:, None]).astype(np.float32), (b / b_length[:, None]).astype(np.float32).T
    room = 4e-7 * (a.shape[1] + 8)  # more than single precision can be off
    found = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(a), _SLAB):
        rough = left[k : k + _SLAB] @ right
        near = rough >= cosine - room
        if not near.any():
            continue
        found[k : k + _SLAB] = near
        i, j = np.nonzero(near & (rough <= cosine + room))
        for at in range(0, len(i), 1 << 16):
            x, y = k + i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            found[x, y] = (a[x] * b[y]).sum(axis=1) / (a_length[x] * b_length[y]) >= cosine
    return found


def forest(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edges (node, smaller node), at most one a node, with the components of what `found` links between `left` and `right`."""
    rows, columns = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    found, left, right = found[np.ix_(rows, columns)], left[rows], right[columns]
    nodes, numbers = np.unique(np.concatenate([left, right]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = numbers[: len(left)], numbers[len(left) :]
    while True:  # the smallest number passes along links
        before = label.copy()
        for k, mine in enumerate(a):
            met = b[found[k]]
            least = min(label[mine], label[met].min())
            label[mine], label[met] = least, np.minimum(label[met], least)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[label[moved]]], axis=1)


def _compared(cosine: float):
    """Of one unit and one chunk of its visitors: (cls, n) counts, and edges (a, b)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        home, guests = group[group.home], group[~group.home]
        mine, theirs = (np.stack(x.v.to_numpy()).astype(np.float64) if len(x) else None for x in (home, guests))
        counts, edges = [(np.zeros(0, np.int64),) * 2], [np.zeros((0, 2), np.int64)]
        if mine is not None and not group.core.any() and group.chunk.iloc[0] == 0:
            found = linked(mine, mine, cosine)
            found |= found.T
            np.fill_diagonal(found, False)
            counts.append((home.cls.to_numpy(), found @ home.weight.to_numpy()))
            edges.append(forest(found, home.node.to_numpy(), home.node.to_numpy()))
        if mine is not None and theirs is not None:
            found = linked(mine, theirs, cosine)
            counts += [(home.cls.to_numpy(), found @ guests.weight.to_numpy()), (guests.cls.to_numpy(), found.T @ home.weight.to_numpy())]
            edges.append(forest(found, home.node.to_numpy(), guests.node.to_numpy()))
        ids, n = (np.concatenate(c) for c in zip(*counts, strict=True))
        pairs = np.concatenate(edges)
        parts = pd.DataFrame({"cls": ids[n > 0], "n": n[n > 0]}), pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
        return pd.concat([p.astype("Int64") for p in parts]).reindex(columns=["cls", "n", "a", "b"]).astype("Int64")

    return run


def _links(classes: DataFrame, cosine: float, unit_rows: int, n: int) -> DataFrame:
    """cls, n (rows of other classes linked, by weight) and root (of its component) of every class; all vectors have one length."""
    radius = math.acos(cosine)
    sample = classes.orderBy("f1", "f2").select("v").limit(SAMPLE_ROWS).collect()
    pivots = choose_pivots(directions(np.array([r[0] for r in sample], np.float64)), -(-n // CELL_ROWS), radius)
    vector = classes.schema["v"].dataType.simpleString()
    homes = stored(classes.select("cls", "weight", "v").mapInArrow(_homes(pivots, radius), f"cls long, weight long, v {vector}, cell int, angle double"), "homes")

    # a row a cell, of which there are twice the pivots
    figures = homes.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("rows"), F.sum("weight").alias("weight"), F.min("cls").alias("node"))
    cells = {r["cell"]: r for r in figures.collect()}
    layout = Layout(pivots, *(np.array([cells[c][name] if c in cells else 0 for c in range(2 * len(pivots))]) for name in ("low", "high", "rows")))
    cores = F.broadcast(homes.sparkSession.createDataFrame([(c, r["node"], r["weight"]) for c, r in cells.items() if c % 2 == 0], "cell int, core long, inside long"))
    homes = homes.join(cores, "cell", "left").withColumn("node", F.coalesce("core", "cls"))

    salt = F.pmod(F.xxhash64("cls"), F.lit(1 << 30)).alias("salt")
    visits = homes.select("cls", "weight", "node", "v", "cell", salt).mapInArrow(_visits(layout, radius, unit_rows), f"cls long, weight long, node long, v {vector}, core boolean, unit int, to array<int>")
    visits = stored(visits, "visits")
    chunks = visits.select(F.explode("to").alias("to")).groupBy("to").agg(F.ceil(F.count("*") / F.lit(2 * unit_rows)).cast("int").alias("chunks"))
    chunks = stored(chunks, "chunks")
    chunk = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("chunks")).cast("int").alias("chunk")
    guests = visits.select("cls", "weight", "node", "v", F.explode("to").alias("to")).join(chunks, "to")
    guests = guests.select("cls", "weight", "node", "v", F.lit(False).alias("core"), F.lit(False).alias("home"), F.col("to").alias("unit"), chunk)
    # every chunk meets all of the unit; a core that nobody visits has nothing to compare
    hosts = visits.join(chunks, visits.unit == chunks["to"], "left").where("NOT core OR chunks IS NOT NULL")
    hosts = hosts.select("cls", "weight", "node", "v", "core", F.lit(True).alias("home"), "unit", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    found = stored(hosts.unionByName(guests).groupBy("unit", "chunk").applyInPandas(_compared(cosine), "cls long, n long, a long, b long"), "links")

    counts = found.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("met"))
    roots = stored(components(found.where("a IS NOT NULL").select("a", "b")), "roots")
    # a core is one node, so its members get the root by its cell, and the other classes by their own number
    core_roots = F.broadcast(cores.join(roots, cores.core == roots.node).select("core", F.col("root").alias("core root")))
    rows = homes.select("cls", "core", (F.coalesce("inside", "weight") - F.col("weight")).alias("inside"))
    rows = rows.join(counts, "cls", "left").join(core_roots, "core", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return rows.select("cls", (F.coalesce("met", F.lit(0)) + F.col("inside")).alias("n"), F.when(F.col("core").isNotNull(), F.coalesce("core root", "core")).otherwise(F.coalesce("root", "cls")).alias("root"))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links (other rows whose vector has at least this cosine, which must be over 0), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing; nor do vectors of unlike
    lengths with each other. Equal vectors link, so repeated rows link with each other. A null id counts in a component only if
    it has no other id; a row is kept if its id is the component's, null for null. Other columns of any name are ignored. An
    empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col).cast("array<float>" if element == "float" else "array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"))
    good = finite(F.col("v")) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    rows = rows.select("vec_id", "v", F.coalesce(good, F.lit(False)).alias("good"), F.xxhash64("v").alias("f1"), F.xxhash64(F.lit(1), "v").alias("f2"))
    grouped = rows.where("good").groupBy("f1", "f2").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("rep"))
    classes = stored(grouped.withColumn("cls", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "vectors")

    # embeddings of one model have one length; each other one that is there is a join of its own
    found = None
    for r in classes.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect():
        part = _links(classes.where(F.col("width") == r["width"]), cosine, unit_rows, r["n"])
        found = part if found is None else found.unionByName(part)
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is not None:
        found = stored(classes.select("f1", "f2", "weight", "rep", "cls").join(found, "cls"), "found")
        groups = stored(found.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes of the root")), "groups")
        named = join_heavy(found, groups, ["root"], "classes of the root", found.count())
        named = stored(named.select("f1", "f2", "weight", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id"), "named")
        total = named.agg(F.sum("weight")).first()[0]
        linked_rows = join_heavy(rows.where("good").select("vec_id", "f1", "f2"), named, ["f1", "f2"], "weight", total)
        alone = linked_rows.select("vec_id", "n_links", "component_id").unionByName(alone)
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The rows of `near_vectors` with its default parameters in DuckDB's SQL.
ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT i, x FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT a.i AS a, b.i AS b FROM g a JOIN g b ON a.i <> b.i AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT i AS a, i AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
c AS (SELECT r.a, min(v.vec_id) AS component_id FROM r JOIN v ON r.b = v.i GROUP BY r.a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON c.a = v.i LEFT JOIN n ON n.a = v.i
"""
