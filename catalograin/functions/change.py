"""Change detection of page texts: volatile lines, tokens, fingerprints and differences, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that change from visit to visit without the listing changing. (Fixed values.)
VOLATILE = [
    r"\b(\d+|an?|one)\s+(sec(ond)?s?|min(ute)?s?|hours?|hrs?|days?|weeks?|months?|years?)\s+ago\b",
    r"\bprije\s+(\d+|par|nekoliko|jedan|jednog|jedne)?\s*(sek|min|sat|sati|sata|dan|dana|sedmic|tjed|nedelj|mjesec|mesec|godin)",
    r"\bvor\s+\d+\s+(sekunden|minuten|stunden?|tagen?|wochen?|monaten?|jahren?)\b",
    r"^\s*(just now|upravo( sada)?|maloprije|danas|jučer|jucer|juče|juce|today|yesterday|heute|gestern)\b",
    r"\b(views?|viewed|pregleda|pregledi|aufrufe|favorites?|favourites?|praćenja|pracenja|followers?)\b",
    r"\b(updated|renewed|refreshed|bumped|obnovljen[oa]?|osvježen[oa]?|osvjezen[oa]?|ažuriran[oa]?|azuriran[oa]?|aktualisiert|last seen|zuletzt online|vrijeme odgovora|response time)\b",
    r"^(pitanja|questions|komentari|comments|fragen)\s*(\(\d+\))?$",
    r"^(izdvojeno|istaknuto|featured|sponsored|promoted|gesponsert|ostali oglasi( korisnika)?|slični oglasi|slicni oglasi|similar (ads|items|listings|products)|more from (this )?seller|you may also like)\b",
    r"^(realna|dobra|odlična|odlicna|visoka|niska|povoljna) cijena$|^(good|fair|great|high) (price|deal)$",
]
#: Labels whose next line holds the changing value, and what such a value looks like. (Fixed values.)
VOLATILE_LABEL = r"^(broj pregleda|pregleda|pregledi|views?|aufrufe|obnovljen[oa]?|osvježen[oa]?|osvjezen[oa]?|ažurirano|azurirano|updated|renewed|last updated|aktualisiert)\s*:?$"
VALUE = r"^[\d\s.,:/-]+(u|at|um)?[\d\s.,:/-]*h?$"


def is_volatile(line: Column) -> Column:
    found = F.lit(False)
    for pattern in VOLATILE:
        found = found | line.rlike(f"(?i){pattern}")
    return (F.length(line) <= 120) & found


def is_label(line: Column) -> Column:
    return line.rlike(f"(?i){VOLATILE_LABEL}")


def stable_lines(text: Column) -> Column:
    """Lines with white space collapsed, without blank and volatile ones and without the value below a volatile label.

    A label is skipped with the short numeric line below it. That line can't be a label itself, so whether a line is such a value depends
    on its predecessor alone, and no state has to be carried.
    """
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    value = lambda x: (F.length(x) <= 40) & x.rlike(f"(?i){VALUE}")
    # each line beside the one above it: looked up by place, the lines would be made anew for each of them
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), is_label(x).alias("label")))
    above = F.concat(F.array(F.lit(False)), F.transform(marked, lambda m: m["label"]))
    keep = lambda m, below: m.isNotNull() & ~(m["label"] | is_volatile(m["line"]) | (F.coalesce(below, F.lit(False)) & value(m["line"])))
    return F.array_compact(F.zip_with(marked, above, lambda m, below: F.when(keep(m, below), m["line"])))


def tokens(text: Column) -> Column:
    """Distinct lower-case words and numbers of the stable lines, sorted."""
    words = F.split(F.lower(F.array_join(stable_lines(text), "\n")), r"[^\p{L}\p{N}.,]+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(".,"))), lambda w: w != "")))


def fingerprint(text: Column) -> Column:
    """The same for texts with equal tokens, whatever their order, case, line breaks and repeats."""
    return F.sha2(F.array_join(tokens(text), " "), 256)


def changed(old: Column, new: Column, most: int = 6) -> Column:
    """A few `- removed` and `+ added` of two token arrays."""
    gone = F.transform(F.array_except(old, new), lambda t: F.concat(F.lit("- "), t))
    added = F.transform(F.array_except(new, old), lambda t: F.concat(F.lit("+ "), t))
    return F.slice(F.concat(gone, added), 1, most)


def removed_share(old: Column, new: Column) -> Column:
    """Share of the old tokens that the new ones lack; 0 if there were none."""
    return F.when(F.size(old) == 0, F.lit(0.0)).otherwise(F.size(F.array_except(old, new)) / F.size(old))
