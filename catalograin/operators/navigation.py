"""Finding the way on listing pages: the control that leads to the next page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What labels of controls to the next and to the previous page look like. (Fixed values.)
NEXT = r"\bnext\b|\bnewer\b|sljede[cć]|slede[cć]|naprijed|napred|dalje|weiter|n[aä]chste|suivant|siguiente|successiv|pr[oó]xim|volgende|następn|další|^\s*(›|»|→|>|>>)\s*$|(›|»|→)\s*$"
PREVIOUS = r"\bprev|previous|\bolder\b|\bback\b|prethodn|nazad|zurück|vorherig|précédent|anterior|precedent|vorige|poprzedn|předchozí|^\s*(‹|«|←|<|<<)|^\s*(‹|«|←)"
LEAST_SCORE = -1.0


def next_control(controls: DataFrame, visited: DataFrame) -> DataFrame:
    """(page_id, pos, href, score): the control of each page that looks most like one to the next page; pages without such one have no row.

    controls: (page_id, here, pos, rel, label, cls, href, disabled); visited: (page_id, url). Ten for `rel`, five for label or class, less as much for the
    previous page; minus eight for a page walked before, fifty if disabled, a hundredth for each control before it. A score below -1 is none. href is null
    where the control is no link to another page: it must be pressed.
    """
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), F.lit(float(n))).otherwise(F.lit(0.0))
    plain = lambda c: F.substring_index(c, "#", 1)
    like = lambda c, pattern: F.col(c).rlike(f"(?i){pattern}")
    seen = visited.select("page_id", plain(F.col("url")).alias("link")).distinct().withColumn("walked", F.lit(True))
    rows = controls.withColumns({"link": plain(F.col("href")), "at": plain(F.col("here"))}).join(seen, ["page_id", "link"], "left")
    web = F.col("link").rlike("^https?:")
    score = (
        points(like("rel", r"\bnext\b"), 10) - points(like("rel", r"\bprev"), 10)
        + points(F.coalesce(like("label", NEXT), F.lit(False)) | F.coalesce(like("cls", "next"), F.lit(False)), 5)
        - points(F.coalesce(like("label", PREVIOUS), F.lit(False)) | F.coalesce(like("cls", "prev"), F.lit(False)), 5)
        - points(F.col("walked") & web & (F.col("link") != F.col("at")), 8) - points(F.col("disabled"), 50) - F.col("pos") / F.lit(100.0)
    )
    target: Column = F.when(web & (F.col("link") != F.col("at")), F.col("href"))
    best = F.max_by(F.struct("pos", target.alias("href"), "score"), F.struct("score", -F.col("pos")))
    return rows.withColumn("score", score).groupBy("page_id").agg(best.alias("b")).select("page_id", "b.pos", "b.href", "b.score").where(F.col("score") >= LEAST_SCORE)
