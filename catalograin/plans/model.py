"""Query plans: what to filter, sort, mean and show. Plain data, rewritten on the driver before any DataFrame is built."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

#: Pseudo-keys that read a listing's own columns, in display order, with their types. (Fixed values.)
LISTING_TYPES = {"price": "number", "title": "string", "description": "string", "product": "string", "currency": "string", "collection": "number"}
#: Listing fields of which a missing value never matches.
STRICT = frozenset(LISTING_TYPES) - {"price"}
OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "in", "exists")
PLAN_VERSION = 2
MAX_FILTERS = 100


@dataclass(frozen=True)
class Key:
    """A registered attribute of items."""

    key: str
    type: str
    unit: str | None = None
    label: str = ""
    example: str | None = None
    count: int = 0
    origin: str = "page"


@dataclass(frozen=True)
class Filter:
    key: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Sort:
    key: str
    dir: str = "asc"


@dataclass(frozen=True)
class Plan:
    filters: tuple[Filter, ...] = ()
    sort: Sort | None = None
    semantic_text: str | None = None
    missing: tuple[Key, ...] = ()
    show: tuple[str, ...] = ()


@dataclass(frozen=True)
class Request:
    """One search: a plan, the panel's filters and sort, and the two pages."""

    plan: Plan = field(default_factory=Plan)
    filters: tuple[Filter, ...] = ()
    sort: Sort | None = None
    limit: int = 60
    offset: int = 0
    unknown_offset: int = 0
    include_gone: bool = False
    facets: bool = False
    enrich: bool = False

    def __post_init__(self):
        if not 1 <= self.limit <= 200 or self.offset < 0 or self.unknown_offset < 0:
            raise ValueError("limit must be 1 to 200, offsets 0 or more")


def normalize_key(name: str) -> str:
    """`[a-z0-9_]`, at most 64 characters: accents go, other characters become one underscore."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not "̀" <= c <= "ͯ")
    return re.sub(r"[^a-z0-9]+", "_", plain.lower()).strip("_")[:64]


def normalize_query(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower()).strip()


def registry_signature(keys: Iterable[Key]) -> str:
    """Names the schema that a cached plan was made for."""
    lines = sorted(f"{k.key}:{k.type}:{k.unit or ''}" for k in keys)
    return hashlib.sha1("\n".join([f"v{PLAN_VERSION}", *lines]).encode()).hexdigest()


def normalize_list(f: Filter) -> Filter | None:
    """One shape for list values: `in` of several, `eq` of one; a list with another operator means nothing."""
    if isinstance(f.value, list | tuple):
        values = list(dict.fromkeys(f.value))
        if f.op not in ("eq", "in") or not values:
            return None
        return Filter(f.key, "eq", values[0]) if len(values) == 1 else Filter(f.key, "in", tuple(values))
    if f.op == "in":
        return None if f.value is None else Filter(f.key, "eq", f.value)
    return f


def _type_of(value: Any) -> str:
    value = value[0] if isinstance(value, list | tuple) and value else value
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"


def sanitize(plan: Plan, registry: Iterable[Key], synonyms: Mapping[str, str] | None = None) -> Plan:
    """The plan in registry names: every key normalised and resolved, unknown ones asked for, what is used not shown twice.

    A name that the registry has stands; else its synonym does. Keys that nobody has become `missing`, with the type of their value.
    """
    known, synonyms = {k.key for k in registry} | set(LISTING_TYPES), synonyms or {}

    def resolve(name: str) -> str:
        name = normalize_key(name)
        return name if name in known else synonyms.get(name, name)

    filters = [n for f in plan.filters[:MAX_FILTERS] if f.op in OPS and (n := normalize_list(replace(f, key=resolve(f.key)))) is not None]
    sort = replace(plan.sort, key=resolve(plan.sort.key)) if plan.sort else None
    missing = {k.key: k for m in plan.missing if (k := replace(m, key=resolve(m.key))).key not in known}
    for f in filters:
        if f.key not in known:
            missing.setdefault(f.key, Key(f.key, "number" if f.op in ("gt", "gte", "lt", "lte") and _type_of(f.value) == "number" else _type_of(f.value), label=f.key))
    if sort and sort.key not in known:
        missing.setdefault(sort.key, Key(sort.key, "number", label=sort.key))
    used = {f.key for f in filters} | ({sort.key} if sort else set())
    show = dict.fromkeys(k for k in map(resolve, plan.show) if k and k not in used)
    for k in show:
        if k not in known:
            missing.setdefault(k, Key(k, "string", label=k))
    return Plan(tuple(filters), sort, plan.semantic_text or None, tuple(missing.values()), tuple(show))


def merge_filters(plan: Plan, panel: Iterable[Filter]) -> Plan:
    """The panel's filters added, but on keys the plan filters itself."""
    own = {f.key for f in plan.filters}
    return replace(plan, filters=plan.filters + tuple(f for f in panel if f.key not in own))


def effective(request: Request, registry: Iterable[Key], synonyms: Mapping[str, str] | None = None) -> Plan:
    """What is run: the plan's own sort before the request's, panel filters merged."""
    registry = list(registry)
    plan = merge_filters(sanitize(request.plan, registry, synonyms), request.filters)
    return plan if plan.sort or not request.sort else replace(plan, sort=request.sort)


def range_filters(key: str, low: float | None, high: float | None) -> list[Filter]:
    return [Filter(key, op, v) for op, v in (("gte", low), ("lte", high)) if v is not None]


def value_filters(key: str, values: list) -> list[Filter]:
    found = normalize_list(Filter(key, "in", values))
    return [found] if found else []


def text_filters(key: str, text: str) -> list[Filter]:
    """One `contains` for each distinct word."""
    return [Filter(key, "contains", w) for w in dict.fromkeys(normalize_query(text).split()) if w]


def boolean_filters(key: str, choice: bool | None) -> list[Filter]:
    return [] if choice is None else [Filter(key, "eq", choice)]


def edit_filters(plan: Plan, key: str, filters: list[Filter]) -> Plan:
    """All filters on a key replaced."""
    return replace(plan, filters=tuple(f for f in plan.filters if f.key != key) + tuple(filters))


def edit_sort(plan: Plan, sort: Sort | None) -> Plan:
    """Another sort; the key sorted by before stays in view."""
    old = plan.sort.key if plan.sort else None
    show = plan.show + ((old,) if old and old not in plan.show and old not in LISTING_TYPES else ())
    return replace(plan, sort=sort, show=show)


def highlight(plan: Plan) -> list[str]:
    """Keys worth a column: sort, filters, shown and missing ones, without listing fields other than the price."""
    keys = [*([plan.sort.key] if plan.sort else []), *(f.key for f in plan.filters), *plan.show, *(k.key for k in plan.missing)]
    return [k for k in dict.fromkeys(keys) if k == "price" or k not in LISTING_TYPES]


def sort_menu(registry: Iterable[Key], top: int = 30) -> list[Key]:
    numeric = [k for k in registry if k.type == "number" and k.count > 0 and k.key != "price"]
    return sorted(numeric, key=lambda k: (-k.count, k.label or k.key))[:top]


def as_number(value: Any) -> float | None:
    """A filter's value as a finite number: numbers, booleans and whole numeric texts."""
    if value is None:
        return None
    try:
        number = float(value if not isinstance(value, str) else value.strip() or 0)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def as_boolean(value: Any) -> bool | None:
    if isinstance(value, bool):
        return value
    text = as_text(value)
    return True if text in ("true", "yes", "1") else False if text in ("false", "no", "0") else None


def as_text(value: Any) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return str(value).lower()
