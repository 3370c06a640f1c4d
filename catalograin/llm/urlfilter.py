"""URL filters: host and path rules, then trust and distrust propagated over the link graph of hosts."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small, stored

DAMPING = 0.85
ROUNDS = 12
#: A host is blocked when its distrust exceeds its trust by as much as a host has half of whose pages rules block.
THRESHOLD = 0.5
#: The host of an absolute link, with its scheme or with that of its page.
_LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"
#: What is no markup of the page itself.
_ASIDE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"


@dataclass(frozen=True)
class Rule:
    """`text` is a host and the beginning of a path, as in `example.net/en/`."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's. Of equally long ones, the first by text."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target) pairs of different hosts, from `pages(host, html)`: a page's absolute links, comments and scripts aside."""
    markup = F.when(F.contains("html", F.lit("//")), F.regexp_replace("html", _ASIDE, " ")).otherwise("")  # without, no link is absolute
    links = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(markup, F.lit(_LINK), F.lit(1)))).alias("target"))
    return links.select("source", lower_ascii(F.col("target")).alias("target")).where("source <> target").distinct()


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, score): personalised PageRank over `links(source, target)` from `seeds(host, seed)`.

    A host hands `damping` of its score to its targets in equal parts and keeps (1 - damping) of its seed; what hosts without
    targets would hand on is lost. Each round joins on the source, sums with map-side combination and is stored.
    """
    degrees = links.groupBy("source").agg(F.count("*").alias("degree"))
    weighted = stored(links.join(degrees, "source"), "links")
    seeds = stored(seeds.select("host", ((1 - damping) * F.col("seed")).alias("score")), "seeds")
    scores = seeds
    for _ in range(rounds if weighted.take(1) else 0):
        handed = weighted.join(scores, F.col("source") == F.col("host")).select(F.col("target").alias("host"), (damping * F.col("score") / F.col("degree")).alias("score"))
        scores = stored(handed.unionByName(seeds).groupBy("host").agg(F.sum("score").alias("score")), "scores")
    return scores


def host_scores(pages: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from `pages(host, html, verdict)`, verdict being that of a rule or null.

    A host's seeds are the shares of its pages that rules allow and block. Trust follows the links; distrust runs against
    them, from hosts with blocked pages to those that link to them.
    """
    share = lambda verdict: F.avg(F.when(F.col("verdict") == verdict, 1.0).otherwise(0.0))
    hosts = pages.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block"))
    hosts = stored(hosts, "hosts")
    links = stored(host_links(pages), "links")
    trust = propagate(links, hosts.where("allow > 0").select("host", F.col("allow").alias("seed")), rounds, damping)
    backwards = links.select(F.col("target").alias("source"), F.col("source").alias("target"))
    distrust = propagate(backwards, hosts.where("block > 0").select("host", F.col("block").alias("seed")), rounds, damping)
    trust, distrust = trust.withColumnRenamed("score", "trust"), distrust.withColumnRenamed("score", "distrust")
    return trust.join(distrust, "host", "full").fillna(0.0)


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits), verdict (`allow` or `block`).

    Equal trust and distrust allow; so does a host that both reach equally.
    A rule's verdict holds; otherwise the host's: `block` if its distrust exceeds its trust by (1 - damping) * threshold or more, else
    `allow`, as for hosts that no seed reaches. Null urls and those without `://` have an empty host and path and are allowed.
    Null html has no links. Repeated rows each get their result, and count in their host's shares; null ids stay; other columns of any
    name are ignored; an empty table gives no rows. Rules are a short list given by the caller.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule in rules:
        verdict = F.when(F.col("rule") == rule.text, F.lit(rule.verdict)).otherwise(verdict)
    rows = rows.withColumn("verdict", verdict)
    scores = host_scores(rows, rounds, damping)
    blocked = stored(scores.where(F.col("distrust") - F.col("trust") >= (1 - damping) * threshold).select("host", F.lit("block").alias("by_host")), "blocked")
    n, letters = blocked.agg(F.count("*"), F.sum(F.octet_length("host"))).first()
    blocked = small(blocked, 64 * n + (letters or 0))
    return rows.drop("html").join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_host", F.lit("allow")).alias("verdict"))


def _spread_sql(name: str, seed: str, source: str, target: str, rounds: int, damping: float) -> str:
    """Common table expressions <name>0 to <name><rounds> (host, score): unrolled rounds along links from source to target."""
    out = [f"{name}s AS (SELECT host, {1 - damping} * {seed} AS score FROM h WHERE {seed} > 0)", f"{name}d AS (SELECT {source} AS host, count(*) AS degree FROM k GROUP BY 1)", f"{name}0 AS (SELECT * FROM {name}s)"]
    for i in range(rounds):
        handed = f"SELECT {target} AS host, {damping} * score / degree AS score FROM k JOIN {name}{i} c ON c.host = k.{source} JOIN {name}d d ON d.host = k.{source}"
        out.append(f"{name}{i + 1} AS (SELECT host, sum(score) AS score FROM ({handed} UNION ALL SELECT * FROM {name}s) GROUP BY host)")
    return ",\n".join(out)


def oracle(rules: list[Rule], threshold: float = THRESHOLD, rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """The rows of `judge_urls` in DuckDB's SQL."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in ordered)
    says = " ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in rules)
    lower = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    link, aside = _LINK.removeprefix("(?i)").replace("'", "''"), _ASIDE.removeprefix("(?is)")
    return f"""
WITH p AS (SELECT page_id, html, translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') ELSE '' END, {lower}) AS host, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
r AS (SELECT *, CASE WHEN host IS NULL THEN NULL {fits} END AS rule FROM p), v AS (SELECT *, CASE {says} END AS said FROM r),
h AS (SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0 ELSE 0.0 END) AS allow, avg(CASE WHEN said = 'block' THEN 1.0 ELSE 0.0 END) AS block FROM v WHERE host <> '' GROUP BY host),
k AS (SELECT DISTINCT source, target FROM (SELECT host AS source, translate(unnest(regexp_extract_all(regexp_replace(html, '{aside}', ' ', 'gis'), '{link}', 1, 'i')), {lower}) AS target FROM v WHERE host <> '') WHERE source <> target),
{_spread_sql("t", "allow", "source", "target", rounds, damping)},
{_spread_sql("x", "block", "target", "source", rounds, damping)},
b AS (SELECT coalesce(t.host, x.host) AS host FROM t{rounds} t FULL JOIN x{rounds} x ON t.host = x.host WHERE coalesce(x.score, 0) - coalesce(t.score, 0) >= {(1 - damping) * threshold})
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""
