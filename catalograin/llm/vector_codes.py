"""Vector codes: each part of a vector becomes the number of the nearest entry of that part's codebook.

All numbers are integers, so sums don't depend on the order of rows. Codebooks are small (parts x entries) and go to every task with a kd-tree
over each one's entries. A round is one pass over the vectors, from which only sums a part and entry come back.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .heavy import join_heavy
from .storage import stored

LEAF_ENTRIES = 8
#: Integers of which some hundred squared differences fit into 64 bits; beyond, Python's own integers take over.
WIDEST = 1 << 26


class KdTree:
    """The entries of one codebook (rows of integers), found by nearest squared distance, ties by the lower row."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, rows: np.ndarray) -> tuple:
        """(least corner, greatest corner, rows of a leaf or None, left, right)."""
        low, high = self.entries[rows].min(axis=0), self.entries[rows].max(axis=0)
        widest = int(np.argmax(high - low))
        if len(rows) <= LEAF_ENTRIES or low[widest] == high[widest]:
            return low, high, np.sort(rows), None, None
        ordered = rows[np.argsort(self.entries[rows, widest], kind="stable")]
        half = len(ordered) // 2
        return low, high, None, self._node(ordered[:half]), self._node(ordered[half:])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the nearest entry and its squared distance, for each point."""
        best = np.full(len(points), -1, np.int64)
        distance = np.zeros(len(points), points.dtype)
        self._visit(self.root, points, np.arange(len(points)), best, distance)
        return best, distance

    def _visit(self, node: tuple, points: np.ndarray, at: np.ndarray, best: np.ndarray, distance: np.ndarray) -> None:
        """Look at `node` for the points `at`. A branch as near as the best so far is entered too, as it may hold the same distance in a lower row."""
        if not len(at):
            return
        _, _, leaf, left, right = node
        if leaf is not None:
            found = ((points[at][:, None, :] - self.entries[leaf][None, :, :]) ** 2).sum(axis=2)
            k = found.argmin(axis=1)  # the first of equals, and a leaf's rows ascend
            d, row = found[np.arange(len(at)), k], leaf[k]
            better = (best[at] < 0) | (d < distance[at]) | ((d == distance[at]) & (row < best[at]))
            best[at[better]], distance[at[better]] = row[better], d[better]
            return
        bounds = [(np.maximum(np.maximum(x[0] - points[at], points[at] - x[1]), 0) ** 2).sum(axis=1) for x in (left, right)]
        left_first = (bounds[0] <= bounds[1]).astype(bool)
        for near, far, mine, bound in ((left, right, left_first, bounds[1]), (right, left, ~left_first, bounds[0])):
            self._visit(near, points, at[mine], best, distance)
            rest, bound = at[mine], bound[mine]
            self._visit(far, points, rest[(bound <= distance[rest]).astype(bool)], best, distance)


@dataclass(frozen=True)
class Codebooks:
    """`entries[part]` is a table of integers, one row an entry."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def arrays(self) -> list[np.ndarray]:
        wide = any(abs(x) >= WIDEST for part in self.entries for entry in part for x in entry)
        return [np.array(part, object if wide else np.int64).reshape(len(part), -1) for part in self.entries]


def _whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) > 2**60 else math.floor(scale * x)


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, a row a vector, for vectors of one length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    if flat.size and np.abs(flat).max() >= WIDEST / scale - 1:
        return np.array([[_whole(x, scale) for x in row] for row in flat.tolist()], object)
    return np.floor(flat * scale).astype(np.int64)


def _assigned(values: np.ndarray, books: list[np.ndarray], trees: list[KdTree]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part, its points, and their nearest rows and distances."""
    width = values.shape[1] // len(trees)
    for part, tree in enumerate(trees):
        points = values[:, part * width : (part + 1) * width]
        if values.dtype == object and books[part].dtype != object:
            tree = KdTree(books[part].astype(object))
        elif books[part].dtype == object:
            points = points.astype(object)
        yield part, points, *tree.nearest(points)


#: Sums travel as digits of this many bits, so none is too large for a long.
DIGIT_BITS = 40
_SUMS = "part int, entry int, place int, digit int, total long, n long"


def _digits(x: int) -> Iterator[tuple[int, int]]:
    """Number and value of the digits of x, from the lowest; the highest has the sign."""
    k = 0
    while abs(x) >> DIGIT_BITS:
        yield k, x & ((1 << DIGIT_BITS) - 1)
        x, k = x >> DIGIT_BITS, k + 1
    yield k, x


def _sums(books: list[np.ndarray], scale: int):
    """Of all vectors of a task: per part, entry and place the sum of components and how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [KdTree(b) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, points, rows, _ in _assigned(integers(batch.column(0), scale), books, trees):
                own = np.zeros(books[part].shape, points.dtype)
                np.add.at(own, rows, points)
                totals[part] = totals[part] + own.astype(object)
                counts[part] += np.bincount(rows, minlength=len(counts[part]))
        used = [(p, e, k) for p, b in enumerate(books) for e in range(len(b)) if counts[p][e] for k in range(b.shape[1])]
        found = [(p, e, k, digit, x, int(counts[p][e])) for p, e, k in used for digit, x in _digits(int(totals[p][e, k]))]
        columns = list(zip(*found, strict=True)) or [[]] * 6
        types = [pa.int32()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["part", "entry", "place", "digit", "total", "n"])

    return run


def _codes(books: list[np.ndarray], scale: int):
    """The other columns, then code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [KdTree(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            values = integers(batch.column(0), scale)
            code, error = np.zeros((len(values), len(books)), np.uint8), np.zeros(len(values), object)
            for part, _, rows, distance in _assigned(values, books, trees):
                code[:, part] = rows
                error = error + distance.astype(object)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([bytes(c).hex() for c in code]), pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    ok = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & ok


def _kept(vectors: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """Rows (v, vec_id, label) that can be coded, and their number of components."""
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"))
    rows = rows.where(finite(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    width = first[0] if first else 0
    return rows.where(F.size("v") == width), width


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codebooks:
    """Codebooks that start from the vectors of the smallest ids and move to their parts' floored means, `rounds` times.

    Only `entries` rows and one sum a part, entry and place come to the driver. An entry without parts stays. Vectors that `encode` drops are not
    seen. Without any vector, every codebook is empty. Equal ids are ordered by their vectors, null ids come last.
    """
    if entries > 256:
        raise ValueError("an entry's number is told in two hex digits, so there can be 256")
    kept, width = _kept(vectors, parts, id_col, vector_col, label_col)
    seeds = [r[0] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    step = width // parts
    books = [[[_whole(x, scale) for x in v[p * step : (p + 1) * step]] for v in seeds] for p in range(parts)]

    def told() -> Codebooks:
        return Codebooks(tuple(tuple(tuple(e) for e in b) for b in books))

    for _ in range(rounds if seeds else 0):
        sums = kept.select("v").mapInArrow(_sums(told().arrays(), scale), _SUMS)
        found: dict[tuple[int, int, int], list[int]] = {}
        for r in sums.groupBy("part", "entry", "place", "digit").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            at = found.setdefault((r["part"], r["entry"], r["place"]), [0, 0])
            at[0] += r["total"] << DIGIT_BITS * r["digit"]
            at[1] = max(at[1], r["n"])  # of the lowest digit, which every task tells
        for (part, entry, place), (total, n) in found.items():
            books[part][entry][place] = total // n
    return told()


def encode(vectors: DataFrame, books: Codebooks, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector that has a code: vec_id, label, code (two hex digits a part), error (its squared distances to the entries).

    Vectors that are null or hold null, NaN or infinite components go, and so do those whose number of components isn't a
    positive multiple of the parts or differs from that of the smallest kept id. Repeated rows stay. An error beyond a long is null.
    """
    parts = len(books.entries)
    kept, _ = _kept(vectors, parts, id_col, vector_col, label_col)
    if not books.entries[0]:  # nothing was there to learn from
        return kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.select("v", "vec_id", "label").mapInArrow(_codes(books.arrays(), scale), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """`encode` with codebooks of `fit` over the same rows, label_error (error summed over equal labels, nulls together) and codebooks_sha256.

    Sums are taken per label first and joined back, so a label that a third of all rows have is no single task's load.
    """
    columns = {"id_col": id_col, "vector_col": vector_col, "label_col": label_col}
    books = fit(vectors, parts, entries, rounds, scale, **columns)
    rows = stored(encode(vectors, books, scale, **columns), "codes")
    labels = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("*").alias("rows of the label"))
    labels = stored(labels.withColumn("label_error", F.expr("try_cast(label_error AS long)")), "labels")
    found = join_heavy(rows, labels, ["label"], "rows of the label", rows.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The rows of `compressed` in DuckDB's SQL."""
    floored = "(s - ((s % n) + n) % n) // n"
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""d{k} AS (SELECT p.id, p.part, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM parts p JOIN c{k} c ON p.part = c.part),
a{k} AS (SELECT id, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM d{k} GROUP BY id, part)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (SELECT part, entry, list(v ORDER BY place) AS x FROM (SELECT part, entry, place, {floored} AS v FROM (
  SELECT a.part, a.entry, u.place, sum(p.x[u.place])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} a JOIN parts p ON a.id = p.id AND a.part = p.part JOIN places u ON true GROUP BY ALL)) GROUP BY part, entry),
c{k + 1} AS (SELECT c.part, c.entry, coalesce(m.x, c.x::HUGEINT[]) AS x FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry)"""
            )
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM documents_vectors),
places AS (SELECT unnest(range(1, (SELECT max(len(v)) FROM kept) // {parts} + 1)) AS place),
parts AS (SELECT id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) r(part)),
c0 AS (SELECT part, id AS entry, x FROM parts WHERE id < {entries}),
{", ".join(steps)},
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM kept JOIN coded USING (id), book
""".replace("documents_vectors", "embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")
