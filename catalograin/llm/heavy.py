"""Joins with a table of few keys that many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys can each have one in so many of the rows, which bounds what is broadcast.
HEAVY_KEYS = 1_000


def join_heavy(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """`rows` with the columns of `table` (unique by `keys`, null equal to null, every key of `rows` in it).

    `count` says how many rows a key meets, `total` how many there are. Keys that one in `HEAVY_KEYS` rows has come
    by broadcast, at most `HEAVY_KEYS` of them; the others by a shuffle, in which no key has more rows than that.
    """
    least = max(1, total // HEAVY_KEYS)
    named = {k: f"{k} of the table" for k in keys}
    table = table.select([F.col(c).alias(named.get(c, c)) for c in table.columns])
    heavy, light = table.where(F.col(count) > least), table.where(F.col(count) <= least)

    def same():
        found = F.lit(True)
        for k, other in named.items():
            found &= F.col(k).eqNullSafe(F.col(other))
        return found

    by_hand = rows.join(F.broadcast(heavy), same(), "inner").drop(*named.values())
    rest = rows.join(F.broadcast(heavy.select(*named.values())), same(), "left_anti")
    return by_hand.unionByName(rest.join(light, same(), "inner").drop(*named.values()))
