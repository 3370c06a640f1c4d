"""Sharding by a k-d tree: weighted medians along the widest metadata dimension until a leaf is one shard."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import small, stored

BINS = 512
#: A cut may miss its share of a leaf's bytes by this part of a shard.
TOLERANCE = 1e-4
#: If a large group lies at the cut, so that it misses by more than this part of a shard, the next dimensions are tried too.
MISS = 5e-3
#: Chunks in which a shard's slots are numbered side by side.
MAX_CHUNKS = 20_000


@dataclass
class _Search:
    """Where a node's cut lies: groups below `low` go left for sure, those above `high` go right."""

    node: int
    column: str
    low: float
    high: float
    need: float = 0.0  # bytes still wanted from [low, high]
    cut: tuple | None = None
    value: float | None = None  # the single value whose groups the hash tells apart
    miss: float = float("inf")  # bytes by which the cut misses its share


def _of_text(column: str) -> Column:
    """A number that orders texts by their first six bytes."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def _narrow(groups: DataFrame, searches: list[_Search]) -> dict[int, list]:
    """Histograms of bytes over each search's range, for all nodes in one job."""
    inside, bin_of, value = F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("double")
    for s in searches:
        column = F.col(s.column) if s.value is None else F.col("tie")
        here = (F.col("node") == s.node) & column.between(s.low, s.high)
        if s.value is not None:
            here &= F.col(s.column) == s.value
        width = (s.high - s.low) / BINS
        place = F.least(F.floor((column - s.low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        inside = inside | here
        bin_of, value = F.when(here, place.cast("int")).otherwise(bin_of), F.when(here, column).otherwise(value)
    rows = groups.where(inside).select("node", "bytes", bin_of.alias("bin"), value.alias("v")).groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"), F.min("v").alias("low"), F.max("v").alias("high"))
    found: dict[int, list] = {s.node: [] for s in searches}
    for r in rows.collect():  # at most BINS rows for each node
        found[r["node"]].append((r["bin"], r["bytes"], r["low"], r["high"]))
    return found


def _cuts(groups: DataFrame, searches: list[_Search], tolerance: float) -> None:
    """Find each node's cut: the groups up to it weigh nearest to the share of the left parts."""
    open_searches = searches
    while open_searches:
        histograms = _narrow(groups, open_searches)
        for s in open_searches:
            bins = sorted(histograms[s.node])
            below = 0
            for k, (_, weight, low, high) in enumerate(bins):
                if below + weight >= s.need or k == len(bins) - 1:
                    break
                below += weight
            if not bins:
                s.cut = (s.low, None)
            elif low == high and s.value is None:  # one value: its groups are told apart by their hash
                s.need -= below
                s.value, s.low, s.high = low, 0.0, 1.0
            elif low == high or weight <= tolerance:
                # the bin goes where it leaves the smaller miss
                edge = high if abs(below + weight - s.need) <= abs(s.need - below) else math.nextafter(low, -math.inf)
                s.cut = (edge, None) if s.value is None else (s.value, edge)
                s.miss = min(abs(below + weight - s.need), abs(s.need - below))
            else:
                s.need -= below
                s.low, s.high = low, high
        open_searches = [s for s in open_searches if s.cut is None]


def kd_shards(groups: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """`groups` (bytes long, tie double in 0..1, and numeric `dims`) with a shard each.

    All nodes of a level are split together: ranges, then histograms of bytes narrowed around the cut, are aggregates of which
    only a bounded number of rows reach the driver. A node of k shards gives floor(k / 2) of them to its left side. Groups of equal
    value are told apart by `tie`. A group is never divided.
    """
    groups = stored(groups.withColumn("node", F.lit(0)), "groups")
    extent = groups.agg(F.sum("bytes").alias("bytes"), *(F.min(d).alias(f"low{i}") for i, d in enumerate(dims)), *(F.max(d).alias(f"high{i}") for i, d in enumerate(dims))).first()
    total = extent["bytes"] or 0
    whole = [max((extent[f"high{i}"] or 0) - (extent[f"low{i}"] or 0), 1e-300) for i in range(len(dims))]
    parts, first = {0: shards}, {0: 0}
    while any(p > 1 for p in parts.values()):
        rows = groups.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(F.min(d).alias(f"low{i}") for i, d in enumerate(dims)), *(F.max(d).alias(f"high{i}") for i, d in enumerate(dims))).collect()
        ranges, pending, best = {r["node"]: r for r in rows if parts[r["node"]] > 1}, [], {}
        widest = {n: sorted(range(len(dims)), key=lambda i: (-(r[f"high{i}"] - r[f"low{i}"]) / whole[i], i)) for n, r in ranges.items()}
        pending = list(ranges)
        for attempt in range(len(dims)):
            searches = []
            for n in pending:
                r, i, p = ranges[n], widest[n][attempt], parts[n]
                searches.append(_Search(n, dims[i], r[f"low{i}"], r[f"high{i}"], r["bytes"] * (p // 2) / p))
            _cuts(groups, searches, TOLERANCE * total / shards)
            for s in searches:
                best[s.node] = min(best.get(s.node, s), s, key=lambda s: s.miss)
            pending = [n for n in pending if best[n].miss > MISS * total / shards]
            if not pending:
                break
        searches = list(best.values())
        node, next_parts, next_first = F.col("node"), {}, {}
        for n, p in parts.items():
            if p == 1:
                next_parts[2 * n + 1], next_first[2 * n + 1] = 1, first[n]
            else:
                next_parts |= {2 * n + 1: p // 2, 2 * n + 2: p - p // 2}
                next_first |= {2 * n + 1: first[n], 2 * n + 2: first[n] + p // 2}
        right = F.lit(False)
        for s in searches:
            value, tie = s.cut
            above = F.col(s.column) > value
            if tie is not None:
                above = above | ((F.col(s.column) == value) & (F.col("tie") > tie))
            right = right | ((F.col("node") == s.node) & above)
        groups = stored(groups.withColumn("node", 2 * node + F.when(right, 2).otherwise(1)), "groups")
        parts, first = next_parts, next_first
    shard = F.lit(None).cast("int")
    for n, f in first.items():
        shard = F.when(F.col("node") == n, F.lit(f)).otherwise(shard)
    return groups.withColumn("shard", shard).drop("node")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes plus 1), text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    Shards have nearly equal bytes. Equal texts are one group and stay together (with null as an empty text), so shares can
    miss by what the largest groups weigh; a group larger than a shard's share makes its shard larger. Dimensions are the logarithm
    of a group's text size, its smallest id, and its smallest values of the `metadata` columns that `docs` has, by their first bytes. Slots
    number a shard's rows from 0 without gaps. Repeated rows each get a slot; null ids are kept; other columns of any name
    are ignored; an empty table gives no rows. Results are the same for the same rows in any order, but for slots.
    """
    extra = [c for c in metadata if c in docs.columns]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(extra)))
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(1), "text").alias("g2"), *(_of_text(f"m{i}").alias(f"m{i}") for i in range(len(extra))),
    )
    rows = stored(rows, "rows")
    groups = rows.groupBy("g1", "g2").agg(
        F.sum("size").alias("bytes"), F.max(F.log("size")).alias("length"), F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("first"), *(F.min(f"m{i}").alias(f"m{i}") for i in range(len(extra))),
    )
    groups = groups.withColumn("tie", F.shiftrightunsigned("g1", 11) / F.lit(float(1 << 53)))
    placed = kd_shards(groups, ["length", "first", *(f"m{i}" for i in range(len(extra)))], shards).select("g1", "g2", "shard")
    placed = rows.select("uid", "doc_id", "size", "text_crc32", "g1", "g2").join(placed, ["g1", "g2"]).drop("g1", "g2")
    return _with_slots(stored(placed, "placed"), shards)


def _with_slots(placed: DataFrame, shards: int) -> DataFrame:
    """Slots: each shard's rows lie in chunks by a hash of uid, numbered side by side from the chunks' counts."""
    per_chunk = max(1000, -(-placed.count() // MAX_CHUNKS))
    chunks = max(1, -(-placed.count() // per_chunk // shards))
    chunked = placed.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int"))
    counts = stored(chunked.groupBy("shard", "chunk").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # at most shards * MAX_CHUNKS rows
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("uid")) - 1
    numbered = chunked.withColumn("place", place).join(small(offsets, 48 * shards * chunks), ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
