"""Text, number and name functions as columns."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

YES = ("yes", "true", "da", "ja", "oui", "si", "1")
NO = ("no", "false", "ne", "nein", "non", "0")


@F.pandas_udf(StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    """Base letters only; Spark has no Unicode decomposition of its own."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    return texts.map(lambda t: t if t is None or t.isascii() else plain(t))


@F.pandas_udf(StringType())
def compatible_letters(texts: pd.Series) -> pd.Series:
    """Base letters and digits only, also of characters that stand for others, as a raised 2 does."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f")
    return texts.map(lambda t: t if t is None or t.isascii() else plain(t))


def attribute_key(name: Column) -> Column:
    """A key's normal form: `[a-z0-9_]`, at most 64 characters; the same as `plans.model.normalize_key`."""
    plain = F.lower(compatible_letters(name))
    return F.substring(F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_")), 1, 64)


def loose_number(text: Column) -> Column:
    """The first number in a text; groups of three after one to three digits are thousands, else a comma is the point."""
    found = F.nullif(F.regexp_extract(F.regexp_replace(text, r"\s", ""), r"-?\d[\d.,]*", 0), F.lit(""))
    grouped = F.regexp_replace(found, "[.,]", "")
    pointed = F.regexp_replace(found, "^([^,]*),", "$1.")
    return F.when(found.rlike(r"^\d{1,3}([.,]\d{3})+$"), grouped).otherwise(pointed).try_cast("double")


def loose_boolean(text: Column) -> Column:
    word = F.lower(F.btrim(text))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def coerced(value: Column, kind: Column) -> Column:
    """A bag's value as `number`, `boolean` or `string`; null if it can't be one. Texts are read loosely and lower-cased."""
    shown = F.coalesce(value["txt"], value["flag"].cast("string"), value["num"].cast("string"))
    number_ = F.coalesce(value["num"], loose_number(value["txt"]))
    flag_ = F.coalesce(value["flag"], loose_boolean(shown))
    text_ = F.lower(F.btrim(F.coalesce(value["txt"], value["flag"].cast("string"), F.regexp_replace(value["num"].cast("string"), r"\.0$", ""))))
    made = F.struct(
        F.when(kind == "number", number_).alias("num"), F.when(kind == "boolean", flag_).alias("flag"), F.when(kind == "string", F.nullif(text_, F.lit(""))).alias("txt"),
    )
    return F.when(made["num"].isNotNull() | made["flag"].isNotNull() | made["txt"].isNotNull(), made)


def collapsed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def identity_name(identity: Column, title: Column) -> Column:
    """The name under which a product is looked up: at most 200 characters of the identity, or the title."""
    return F.substring(collapsed(F.lower(F.coalesce(F.nullif(identity, F.lit("")), title))), 1, 200)


def padded_name(name: Column) -> Column:
    """Letters and digits of a name as words, between spaces, so that whole words can be found by `contains`."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(without_accents(name)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def source_matches(brand: Column, source: Column) -> Column:
    """Whether a source names the brand; with nothing to compare, it does."""
    nothing = F.coalesce(F.btrim(brand) == "", F.lit(True)) | F.coalesce(F.btrim(source) == "", F.lit(True))
    return nothing | padded_name(source).contains(padded_name(brand))


def humanized(key: Column) -> Column:
    words = F.regexp_replace(key, "_", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000))


#: How units are shown, by their usual spellings. (Fixed values.)
UNITS = {
    "kw": "kW", "hp": "hp", "ps": "hp", "cc": "cc", "ccm": "cc", "l": "L", "liters": "L", "litres": "L", "kg": "kg", "mm": "mm", "cm": "cm", "km": "km", "inch": "″", "s": "s", "gb": "GB", "tb": "TB",
    "mah": "mAh", "w": "W",
}


def display_unit(unit: Column) -> Column:
    """A unit as it is shown; unknown ones as they are, an empty one is none."""
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(known[F.lower(unit)], F.nullif(unit, F.lit("")))


def spec_label(key: Column) -> Column:
    """A key as a label, without a unit at its end: the value shows it."""
    units = "|".join(UNITS)
    return humanized(F.regexp_replace(key, f"(?<=.)_({units})$", ""))


def display_number(value: Column, unit: Column) -> Column:
    """At most two decimals, thousands grouped, then the unit; inches without a space."""
    shown = F.regexp_replace(F.regexp_replace(F.format_number(value, 2), "0+$", ""), r"\.$", "")
    return F.when(unit == "″", F.concat(shown, unit)).otherwise(F.concat_ws(" ", shown, unit))


def display_value(value: Column, unit: Column) -> Column:
    """A bag's value for readers; a dash for none."""
    flag_ = F.when(value["flag"], "yes").when(~value["flag"], "no")
    number_ = F.when(value["num"].isNotNull(), display_number(value["num"], display_unit(unit)))
    return F.coalesce(flag_, number_, value["txt"], F.lit("—"))


def context_specs(specs: Column, most: int = 15) -> Column:
    """What a lookup is told about an item: its attributes but flags, those that name maker and model first, as one text."""
    rank = lambda k: F.when(k.rlike("(?i)brand|manufacturer|maker|marka|proizvo"), 0).when(k.rlike("(?i)model"), 1).otherwise(2)
    shown = lambda v: F.coalesce(v["txt"], F.regexp_replace(v["num"].cast("string"), r"\.0$", ""))
    entries = F.filter(F.map_entries(specs), lambda e: e["value"]["flag"].isNull())
    placed = F.array_sort(F.transform(entries, lambda e: F.struct(rank(e["key"]).alias("rank"), e["key"].alias("key"), shown(e["value"]).alias("text"))))
    return F.array_join(F.transform(F.slice(placed, 1, most), lambda p: F.concat(p["key"], F.lit(": "), p["text"])), ", ")


def source_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


_CLOSES = {"[": "]", "{": "}"}


def _closed(text: str) -> list[tuple[int, str]]:
    """Where a bracket closes, and what is still open there, closed."""
    found, stack, quoted, skip = [], [], False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in _CLOSES:
            stack.append(_CLOSES[c])
        elif c in "]}":
            if stack:
                stack.pop()
            found.append((i + 1, "".join(reversed(stack))))
    return found


def mended_json(answer: str | None, tries: int = 400) -> str | None:
    """The JSON of a chatty, fenced or broken answer, in compact form; null if there is none.

    Backslashes that escape nothing are doubled. What broke off is cut behind the last bracket from which closing all that is open makes it whole.
    """
    if answer is None:
        return None

    def read(text: str):
        for candidate in (text, re.sub(r"\\(?![\"\\/bfnrtu])", r"\\\\", re.sub(r"\\\\", "\0", text)).replace("\0", r"\\")):
            try:
                return json.loads(candidate)
            except ValueError:
                continue
        raise ValueError

    answer = answer.strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S | re.I) or re.search(r"([\[{].*[\]}])", answer, re.S)
    for text in (answer, *([fenced.group(1)] if fenced else [])):
        try:
            return json.dumps(read(text), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            continue
    start = re.search(r"[\[{]", answer)
    rest = answer[start.start() :] if start else ""
    for cut, closing in _closed(rest)[::-1][:tries]:
        try:
            return json.dumps(json.loads(rest[:cut] + closing), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def answer_json(answers: pd.Series) -> pd.Series:
    """Model answers as JSON texts. Of a broken one, what came before the break stays."""
    return answers.map(mended_json)


def first_line(text: Column) -> Column:
    """The first line with anything but white space, without that at its ends, at most 200 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.substring(F.get(lines, F.lit(0)), 1, 200)


def card_snippet(text: Column, title: Column) -> Column:
    """A card's lines without its title (or a cut-off copy of it), joined, at most 300 characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: collapsed(x))
    plain = F.lower(title)
    stem = lambda x: F.regexp_replace(F.lower(x), r"(\.{3}|…)$", "")
    other = F.filter(lines, lambda x: (x != "") & ~F.coalesce((F.lower(x) == plain) | ((stem(x) != F.lower(x)) & (stem(x) != "") & plain.startswith(stem(x))), F.lit(False)))
    return F.substring(F.array_join(other, " · "), 1, 300)


def embedding_text(title: Column, identity: Column, description: Column, specs: Column) -> Column:
    """What an item is embedded by: its names, description and attributes, yes or no for flags."""
    value = lambda v: F.coalesce(v["txt"], F.when(v["flag"], "yes").when(~v["flag"], "no"), v["num"].cast("string"))
    attributes = F.transform(F.array_sort(F.map_entries(specs), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: F.concat(F.regexp_replace(e["key"], "_", " "), F.lit(": "), value(e["value"])))
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(identity, F.lit("")), F.nullif(description, F.lit("")), F.array_join(attributes, ", "))
