"""URL functions as columns, and patterns of item pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that only say where a visitor came from. (Fixed values.)
TRACKING = r"(?:utm_[^=&#]*|fbclid|gclid|ref|ref_[^=&#]*|sponsored[^=&#]*|position[^=&#]*|pos|from)"
MAX_URL = 2048


def item_url(url: Column) -> Column:
    """An item's URL without fragment and tracking parameters."""
    plain = F.regexp_replace(url, "#.*$", "")
    head, query = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^{TRACKING}(=|$)"))
    return F.when(F.size(kept) > 0, F.concat(head, F.lit("?"), F.array_join(kept, "&"))).otherwise(head)


def with_page(url: Column, name: str, page: Column) -> Column:
    """The URL with a page parameter set."""
    plain = F.regexp_replace(url, "#.*$", "")
    kept = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith(f"{name}="))
    return F.concat(F.regexp_extract(plain, r"^([^?]*)", 1), F.lit("?"), F.array_join(F.concat(kept, F.array(F.concat(F.lit(f"{name}="), page.cast("string")))), "&"))


def safe_link(url: Column) -> Column:
    """Links to the web of a bearable length; others are null."""
    return F.when(url.rlike(r"(?i)^https?://") & (F.length(url) <= MAX_URL), url)


def link_shape(url: Column) -> Column:
    """Host and path with numbers of three digits or more, and the last segment, as `*`."""
    path = F.regexp_extract(url, r"^[a-zA-Z][^:]*://([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    inner = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda p, i: F.when((i > 0) & p.rlike(r"\d{3,}"), "*").otherwise(p))
    return F.array_join(F.when(F.size(parts) > 1, F.concat(inner, F.array(F.lit("*")))).otherwise(inner), "/")


def common_shape(urls: DataFrame, url_col: str = "url", least: int = 5) -> DataFrame:
    """(host, shape, links): for each host the shape of most distinct links, if there are `least`."""
    shaped = urls.select(F.col(url_col).alias("u")).where("u IS NOT NULL").distinct().withColumn("shape", link_shape(F.col("u"))).withColumn("host", F.regexp_extract("u", r"://([^/?#]*)", 1))
    counted = shaped.groupBy("host", "shape").agg(F.count("*").alias("links")).where(F.col("links") >= least)
    best = F.max(F.struct("links", F.col("shape")))
    return counted.groupBy("host").agg(best.alias("b")).select("host", "b.shape", "b.links")


def directory_prefixes(urls: DataFrame, url_col: str = "url", share: float = 0.8, least: int = 3) -> DataFrame:
    """(host, prefix, links): for each host with `least` links, the deepest directory that at least `share` of them lie in."""
    rows = urls.select(F.col(url_col).alias("u")).where("u IS NOT NULL").distinct().select(F.regexp_extract("u", r"://([^/?#]*)", 1).alias("host"), F.regexp_extract("u", r"://[^/?#]*(/[^?#]*)", 1).alias("path"))
    rows = rows.where("host <> ''")
    whole = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    parts = F.split("path", "/")
    # directories only: what lies before the last segment
    depths = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    prefixes = rows.select("host", parts.alias("parts"), F.explode(depths).alias("depth")).select("host", "depth", F.concat(F.array_join(F.slice("parts", 1, F.col("depth")), "/"), F.lit("/")).alias("prefix"))
    counted = prefixes.groupBy("host", "depth", "prefix").agg(F.count("*").alias("links")).join(whole, "host").where(F.col("links") >= share * F.col("n"))
    return counted.groupBy("host").agg(F.max(F.struct("depth", "links", "prefix")).alias("b")).select("host", "b.prefix", "b.links")


def parent_domains(host: Column) -> Column:
    """A host and every domain above it."""
    count = F.size(F.split(host, r"\."))
    return F.transform(F.sequence(count, F.lit(1), F.lit(-1)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


#: Paths of adverts on hosts that also serve real content, and those hosts. (Fixed values.)
AD_PATHS = ["/pagead/", "/rmkt/", "/ccm/collect", "/ads/"]
AD_HOSTS = r"^(www\.)?google(\.[a-z]{2,3}){1,2}$"


def is_tracker(host: Column, trackers: list[str], path: Column | None = None) -> Column:
    """Whether a host, or a domain above it, is in a (short) list, or the path is one of adverts on a host that has both."""
    found = F.arrays_overlap(parent_domains(F.lower(host)), F.array(*map(F.lit, trackers)))
    if path is None:
        return found
    advert = F.lit(False)
    for p in AD_PATHS:
        advert = advert | path.startswith(p)
    return found | (F.lower(host).rlike(AD_HOSTS) & advert)


def slug_words(urls: DataFrame, url_col: str = "url", share: float = 0.8, least: int = 3) -> DataFrame:
    """(host, segments, word, links): for each host the word that stands inside the last segment of at least `share` of its links.

    Most links must have the same number of path segments; a segment's first and last word, a name and an id, don't count. Of equally frequent words the
    longest, then the first by name.
    """
    path = F.regexp_extract("u", r"://[^/?#]*([^?#]*)", 1)
    rows = urls.select(F.col(url_col).alias("u")).where("u IS NOT NULL").distinct().select(F.regexp_extract("u", r"://([^/?#]*)", 1).alias("host"), F.filter(F.split(path, "/"), lambda s: s != "").alias("s"))
    rows = rows.where((F.col("host") != "") & (F.size("s") > 0)).withColumn("segments", F.size("s"))
    all_ = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    shapes = rows.groupBy("host", "segments").agg(F.count("*").alias("links")).join(all_, "host").where(F.col("links") >= share * F.col("n"))
    inner = F.split(F.lower(F.element_at("s", -1)), "-")
    words = rows.select("host", "segments", F.explode(F.array_distinct(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))))).alias("word")).where(F.col("word").rlike("^[a-z]{3,}$"))
    counted = words.groupBy("host", "segments", "word").agg(F.count("*").alias("links")).join(shapes.select("host", "segments", "n"), ["host", "segments"])
    best = F.min_by(F.struct("segments", "word", "links"), F.struct(-F.col("links"), -F.length("word"), "word"))
    return counted.where(F.col("links") >= share * F.col("n")).groupBy("host").agg(best.alias("b")).select("host", "b.segments", "b.word", "b.links")


def tighter_prefixes(saved: DataFrame, urls: DataFrame) -> DataFrame:
    """(host, prefix, tighter): saved prefixes of item URLs, and the longer one that all of a host's links have, or null to keep the saved one."""
    found = directory_prefixes(urls).select("host", F.col("prefix").alias("found"), "links")
    path = F.regexp_extract("url", r"://[^/?#]*(/[^?#]*)", 1)
    total = urls.where("url IS NOT NULL").select("url").distinct().where(path != "").groupBy(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host")).agg(F.count("*").alias("all"))
    joined = saved.join(found, "host", "left").join(total, "host", "left")
    fits = (F.col("links") == F.col("all")) & F.col("found").startswith(F.col("prefix")) & (F.col("found") != F.col("prefix"))
    return joined.select("host", "prefix", F.when(fits, F.col("found")).alias("tighter"))


_SAFE_PATTERN = re.compile(r"^[\w\-./:%~^$?=&+\\()|\[\]*{},]{1,200}$")


def is_safe_pattern(pattern: str) -> bool:
    """Whether a URL pattern made elsewhere may be run: short, plain characters, valid, no repeat of a repeat, no look-around."""
    if not _SAFE_PATTERN.match(pattern) or re.search(r"\([^)]*[*+}][^)]*\)[*+{]|\(\?|\\\d", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def safe_pattern(pattern: Column) -> Column:
    """`is_safe_pattern` of every row; null is not safe. Whether a pattern is valid can only be told by compiling it."""
    return F.pandas_udf(lambda rows: rows.map(lambda p: isinstance(p, str) and is_safe_pattern(p)).astype(bool), "boolean")(pattern)
