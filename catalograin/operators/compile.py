"""Filters over the bag as columns, with three outcomes: match, reject, cannot be judged yet."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import LISTING_TYPES, STRICT, Filter, as_boolean, as_number, as_text

_COMPARE = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def _listing(key: str) -> Column:
    if key == "product":
        return F.coalesce(F.nullif(F.col("identity"), F.lit("")), F.col("title"))
    return F.col("collection_id") if key == "collection" else F.col(key)


def number_text(num: Column) -> Column:
    """A number as text: whole ones without a point."""
    return F.when(num == F.floor(num), F.floor(num).cast("string")).otherwise(num.cast("string"))


def text_value(key: str) -> Column:
    """A key's value of any type as text."""
    if key in LISTING_TYPES:
        column = _listing(key)
        return number_text(column.cast("double")) if LISTING_TYPES[key] == "number" else column
    value = F.col("specs")[F.lit(key)]
    return F.coalesce(value["txt"], number_text(value["num"]), value["flag"].cast("string"))


def typed_value(key: str, kind: str) -> Column:
    """A key's value in its registered type; null if it is missing or not of that type. Whole numeric texts are numbers."""
    if key in LISTING_TYPES:
        return _listing(key)
    value = F.col("specs")[F.lit(key)]
    if kind == "number":
        return F.coalesce(value["num"], value["txt"].try_cast("double"))
    return value["flag"] if kind == "boolean" else text_value(key)


def has_value(key: str, kind: str) -> Column:
    column = typed_value(key, kind)
    present = column.isNotNull()
    return present & (column != "") if key in STRICT and LISTING_TYPES[key] == "string" else present


@dataclass(frozen=True)
class Compiled:
    """`pending`: no one has the key; `skip`: the filter says nothing; `exists`: judged by presence; `condition`: a column."""

    kind: str
    condition: Column | None = None


def _condition(f: Filter, kind: str) -> Column | None:
    """The bare condition, or None if its value can't be compared."""
    typed = typed_value(f.key, kind)
    if f.op == "in":
        values = f.value if isinstance(f.value, list | tuple) else [f.value]
        parsed = [x for v in values if (x := as_number(v) if kind == "number" else as_text(v)) is not None]
        if kind == "boolean" or not parsed:
            return None
        return typed.cast("double").isin(parsed) if kind == "number" else F.lower(typed).isin(parsed)
    if isinstance(f.value, list | tuple):
        return None
    if f.op == "contains":
        text = as_text(f.value)
        return None if text is None else F.lower(text_value(f.key)).contains(text)
    if kind == "number":
        number = as_number(f.value)
        return None if number is None else _COMPARE[f.op](typed.cast("double"), F.lit(number))
    if kind == "boolean":
        flag = as_boolean(f.value)
        return None if flag is None or f.op not in ("eq", "neq") else _COMPARE[f.op](typed, F.lit(flag))
    text = as_text(f.value)
    return None if text is None else _COMPARE[f.op](F.lower(typed), F.lit(text))


def compile_filter(f: Filter, types: Mapping[str, str]) -> Compiled:
    """A filter as a column that keeps rows which lack a key that isn't strict (they can't be judged yet)."""
    kind = LISTING_TYPES.get(f.key) or types.get(f.key)
    if kind is None:
        return Compiled("pending")
    if f.op == "exists":
        return Compiled("condition", has_value(f.key, kind)) if f.key in STRICT else Compiled("exists")
    condition = _condition(f, kind)
    if condition is None:
        return Compiled("skip")
    return Compiled("condition", condition if f.key in STRICT else typed_value(f.key, kind).isNull() | condition)


def scoped(items: DataFrame, collections: int | list[int] | None = None, include_gone: bool = False) -> DataFrame:
    """Items of one collection, of a list (none if it is empty) or of all; vanished ones only if asked for."""
    if collections is not None:
        chosen = [collections] if isinstance(collections, int) else list(collections)
        items = items.where(F.col("collection_id").isin(chosen) if chosen else F.lit(False))
    return items if include_gone else items.where(F.col("gone_at").isNull())


def readable(collections: DataFrame, user_id: int, is_admin: bool = False) -> DataFrame:
    """Collections a user may read: their own and shared ones, for an admin all. Columns id, owner_id, shared."""
    return collections if is_admin else collections.where((F.col("owner_id") == user_id) | F.col("shared"))


def candidates(items: DataFrame, filters: Iterable[Filter], types: Mapping[str, str]) -> tuple[DataFrame, list[Filter], list[Filter]]:
    """Rows that no active filter rejects, the filters that apply, and those on keys nobody has yet, which wait for values."""
    active, pending = [], []
    for f in filters:
        compiled = compile_filter(f, types)
        if compiled.kind == "pending":
            pending.append(f)
        elif compiled.kind != "skip":
            active.append(f)
            if compiled.condition is not None:
                items = items.where(compiled.condition)
    return items, active, pending


def bucketed(rows: DataFrame, active: Iterable[Filter], types: Mapping[str, str]) -> DataFrame:
    """`bucket`: `unknown` for rows that lack a key some active filter asks for, else `matched`."""
    lacking = F.lit(False)
    for key in dict.fromkeys(f.key for f in active if f.key not in STRICT):
        lacking = lacking | ~has_value(key, LISTING_TYPES.get(key) or types[key])
    return rows.withColumn("bucket", F.when(lacking, "unknown").otherwise("matched"))
