"""Line dedup by a log-template tree, in DataFrame operations only.

A line's path in the tree has a fixed depth: its token count, then its leading tokens, those with a digit masked. In a leaf,
positions whose most frequent token has no majority are variable, the others constant; a line that agrees with the constant
positions at a least share of its tokens belongs to the leaf's template. The leaf's other lines form further templates: two lines of one
template agree on at least one of as many stretches of tokens as it may have variable positions, and one more, so lines meet by
stretch, and each stretch that lines share has a template by majority; a line joins the heaviest it fits. This is done for
templates with few variable fields first, then for those with more. A line that fits none is a template of its own. Templates
found in `min_docs` documents or more are recurring: of all their lines, the first (by document, then place) stays, the others go.

Leaves and templates work on distinct lines with their counts, by hash, so a line that a third of all documents repeat is one row
there; texts are read again only for leaves with more than one distinct line. Where such a line's places are looked up, the
most frequent lines, of which there can be no more than a fixed number, are joined without a shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small, stored

WILD = "<*>"
PERCENTS = (80, 60)
#: A line with more than this share of all lines is joined by a broadcast, of at most as many lines as the inverse.
HOT_SHARE = 1e-3
_PLACE = ("id", "th", "pos")
#: So many lines, of so many tokens in all, are brought together at a time where a majority is found.
MOST_MET, MOST_TOKENS = 64, 200_000
#: The leaf of lines too short for one; those of middling length have none.
SHORT = 0


def masked(text: Column) -> Column:
    """A text whose white space within lines is one space, and whose tokens with a digit are the wild card."""
    odd = functools.reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\f", "\r")))
    plain = F.when(odd, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", WILD)).otherwise(plain)


def _least(n: Column, percent: int, depth: int) -> Column:
    """Constant tokens that a template of n tokens has at least: a share of all, and two beyond the leading ones."""
    return F.greatest(F.floor((n * percent + 99) / 100), F.least(n, F.lit(depth + 2))).cast("int")


def _agreed(template: Column) -> Column:
    """Constant positions of a template where the line's token is the same."""
    return F.size(F.filter(F.arrays_zip("tokens", template.alias("token")), lambda p: (p["tokens"] == p["token"]) & (p["token"] != WILD)))


def _reduced(rows: DataFrame, key: str, levels: int, merged) -> DataFrame:
    """(key, state): the `state` arrays of rows (key, chunk, chunks, per, state) brought together position by position, about `per` arrays at a time."""
    for _ in range(levels):
        states = rows.groupBy(key, "chunk").agg(F.collect_list("state").alias("states"), F.first("chunks").alias("chunks"), F.first("per").alias("per"))
        state = F.aggregate(F.slice("states", F.lit(2), F.size("states")), F.element_at("states", 1), lambda x, y: F.zip_with(x, y, merged))
        chunks = F.ceil(F.col("chunks") / F.col("per")).cast("int")
        rows = states.select(key, F.pmod("chunk", chunks).alias("chunk"), chunks.alias("chunks"), "per", state.alias("state"))
    return rows.select(key, "state")


def _outvoted(x: Column, y: Column) -> Column:
    """What is left when votes for unlike tokens cancel out: a token with more than half of all votes is never lost."""
    more = F.when(x["n"] >= y["n"], x["token"]).otherwise(y["token"])
    return F.struct(more.alias("token"), F.when(x["token"] == y["token"], x["n"] + y["n"]).otherwise(F.abs(x["n"] - y["n"])).alias("n"))


def _majority(lines: DataFrame, key: str) -> DataFrame:
    """(key, template) of lines (key, lines, h1, h2, n, tokens): the tokens that more than half of the lines have, else the wild card.

    A vote by position leaves one token that may have the majority, and its lines are counted then. A line stays one row: a row for each
    token would be a row for each stretch that lines share times each of their tokens, and the tokens of one line meet in many stretches.
    """
    per = F.greatest(F.lit(2), F.least(F.lit(MOST_MET), F.floor(F.lit(MOST_TOKENS) / F.size("tokens")))).cast("int")
    lines = lines.withColumn("per", per).withColumn("chunks", F.ceil(F.col("lines") / F.col("per")).cast("int"))
    lines = lines.select(key, "n", "tokens", "per", "chunks", F.pmod(F.xxhash64("h1", "h2"), "chunks").cast("int").alias("chunk"))
    most, least = lines.agg(F.max("chunks"), F.min("per")).first()
    levels = 1
    while (most or 1) > 1:
        most, levels = -(-most // least), levels + 1
    votes = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.col("n").alias("n")))
    voted = _reduced(lines.withColumn("state", votes), key, levels, _outvoted).select(key, F.col("state.token").alias("likely"))
    counts = F.zip_with("tokens", "likely", lambda t, c: F.when(t == c, F.col("n")).otherwise(F.lit(0)))
    totals = F.concat(counts, F.array("n"))  # the last is that of all lines
    sums = _reduced(lines.join(voted, key).withColumn("state", totals), key, levels, lambda x, y: x + y)
    constant = F.zip_with("likely", F.slice("state", F.lit(1), F.size("likely")), lambda c, n: F.when(n * 2 > F.element_at("state", -1), c).otherwise(F.lit(WILD)))
    return sums.join(voted, key).select(key, constant.alias("template"))


def _fitted(lines: DataFrame, key: str, percent: int, depth: int) -> DataFrame:
    """(h1, h2, n, size, template, agreed) of lines (key, lines, h1, h2, n, tokens) that agree with their key's majority at a least share of tokens.

    `lines` is how many lines have the key; most often two, which need no count of every token.
    """
    line = F.struct("h1", "h2", "n", "tokens")
    pairs = lines.where("lines = 2").groupBy(key).agg(F.min(line).alias("a"), F.max(line).alias("b"))
    equal = F.zip_with("a.tokens", "b.tokens", lambda x, y: F.when(x == y, x).otherwise(F.lit(WILD)))
    template = F.when(F.col("a.n") > F.col("b.n"), F.col("a.tokens")).when(F.col("b.n") > F.col("a.n"), F.col("b.tokens")).otherwise(equal)
    pairs = pairs.select(template.alias("template"), F.explode(F.array("a", "b")).alias("x")).select("x.*", "template")
    many = lines.where("lines > 2")
    many = many.join(_majority(many, key), key).select("h1", "h2", "n", "tokens", "template")
    rows = pairs.unionByName(many).withColumns({"agreed": _agreed(F.col("template")), "size": F.size("tokens")}).where(F.col("agreed") >= _least(F.col("size"), percent, depth))
    return stored(rows.select("h1", "h2", "n", "size", F.array_join("template", " ").alias("template"), "agreed").distinct(), "fits")


def _heaviest(fits: DataFrame) -> DataFrame:
    """(h1, h2, template): for each line the heaviest template that it shares with another line."""
    weights = fits.groupBy("template").agg(F.sum("n").alias("w"), F.count("*").alias("lines")).where("lines > 1").drop("lines")
    return stored(fits.join(weights, "template").groupBy("h1", "h2").agg(F.max(F.struct("w", "template")).alias("top")).select("h1", "h2", "top.template"), "templates")


def _by_stretch(rest: DataFrame, percent: int, depth: int) -> DataFrame:
    """`_fitted` lines of (leaf, h1, h2, n, tokens), in groups with an equal stretch of tokens."""
    n = F.size("tokens")
    rest = rest.withColumn("n_bands", F.least(n - _least(n, percent, depth) + 1, n - depth))
    band = F.col("band")
    start, stop = (F.floor((band + k) * (n - depth) / F.col("n_bands")).cast("int") for k in (0, 1))
    banded = rest.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("n_bands") - 1)))
    banded = stored(banded.select(F.xxhash64("leaf", "band", F.slice("tokens", start + depth + 1, stop - start)).alias("bucket"), "h1", "h2"), "banded")
    # a template comes of a bucket's lines alone, so of stretches that the same lines share one is enough: long lines share very many
    mark = F.bit_xor(F.xxhash64("h1", "h2")), F.bit_xor(F.xxhash64(F.lit(1), "h1", "h2"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("lines"), mark[0].alias("m1"), mark[1].alias("m2")).where("lines > 1")
    buckets = buckets.groupBy("lines", "m1", "m2").agg(F.min("bucket").alias("bucket")).select("bucket", "lines")
    shared = stored(banded.join(buckets, "bucket"), "shared")
    met = rest.select("h1", "h2", "n", "tokens").join(small(shared, 64 * shared.count()), ["h1", "h2"])
    return _fitted(stored(met, "met"), "bucket", percent, depth)


def _templates(source: DataFrame, distinct: DataFrame, percents: Sequence[int], depth: int) -> DataFrame:
    """The lines of `distinct` that share their leaf with others and fit a template, with g1, g2 for it."""
    varied = stored(distinct.where(F.col("leaf") != SHORT).groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1"), "varied")
    lines = stored(distinct.join(small(varied, 48 * varied.count()), "leaf"), "varied")
    wanted = lines.groupBy("first.id", "first.th").agg(F.collect_list(F.struct("first.pos", "leaf", "lines", "h1", "h2", "n")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    rows, places = wanted.agg(F.count("*"), F.sum(F.size("wanted"))).first()
    texts = source.alias("d").join(small(wanted, 40 * rows + 56 * (places or 0)).alias("s"), F.expr("d.id <=> s.id AND d.th = s.th"))
    # split below the generator, which would otherwise split the text again for each line
    listed = texts.select(F.split(masked(F.col("d.text")), "\n", -1).alias("all"), "s.wanted").select("all", F.explode("wanted").alias("w"))
    listed = listed.select("w.leaf", "w.lines", "w.h1", "w.h2", "w.n", F.split(F.btrim(F.element_at("all", F.col("w.pos") + 1)), " ").alias("tokens"))
    listed = stored(listed.dropDuplicates(["h1", "h2"]), "leaves")

    found = [_heaviest(_fitted(listed, "leaf", percents[-1], depth))]
    keys = found[0].select("h1", "h2")
    rest = listed.drop("lines").join(small(keys, 48 * keys.count()), ["h1", "h2"], "left_anti")
    fits = _by_stretch(rest, percents[-1], depth)
    for percent in percents:
        found.append(_heaviest(fits.where(F.col("agreed") >= _least(F.col("size"), percent, depth))))
        fits = fits.join(found[-1].select("h1", "h2"), ["h1", "h2"], "left_anti")
    named = functools.reduce(DataFrame.unionByName, found).select("h1", "h2", F.xxhash64("template").alias("g1"), F.xxhash64(F.lit(1), "template").alias("g2"))
    return stored(lines.drop("lines").join(small(named, 64 * named.count()), ["h1", "h2"]), "templated")


def _at_lines(occurrences: DataFrame, lines: DataFrame) -> DataFrame:
    """The occurrences of `lines` (h1, h2, n and more), which are joined as their number and frequencies allow."""
    total = occurrences.count()
    keys = ["h1", "h2"]
    rows = lines.count()
    if small(lines, 120 * rows) is not lines:
        return occurrences.join(F.broadcast(lines.drop("n")), keys)
    hot = F.broadcast(lines.where(F.col("n") > HOT_SHARE * total).drop("n"))
    others = occurrences.join(hot.select(*keys), keys, "left_anti").join(lines.where(F.col("n") <= HOT_SHARE * total).drop("n"), keys)
    return occurrences.join(hot, keys).unionByName(others)


def recurring_lines(source: DataFrame, depth: int, percents: Sequence[int], min_docs: int, short_docs: int, min_tokens: int, min_chars: int) -> DataFrame:
    """(id, th, gone): the places of the lines that go from texts `source(id, text, th)`."""
    lines = source.select("id", "th", F.posexplode(F.split(masked(F.col("text")), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line")).where(F.replace(F.replace("line", F.lit(WILD), F.lit("")), F.lit(" "), F.lit("")) != "")
    lines = lines.withColumn("n_tokens", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    short = (F.col("n_tokens") < min_tokens) & (F.length("line") < min_chars)
    leaf = F.when(short, SHORT).when(F.col("n_tokens") > depth + 2, F.xxhash64("n_tokens", F.substring_index("line", " ", depth)))
    hashes = F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    occurrences = stored(lines.select(*_PLACE, leaf.alias("leaf"), *hashes), "lines")

    doc = F.xxhash64("id", "th")
    distinct = occurrences.groupBy("h1", "h2").agg(F.min("leaf").alias("leaf"), F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first"), F.min(doc).alias("low"), F.max(doc).alias("high"))
    distinct = stored(distinct, "distinct")
    # a line that stands once, and fits no template, is no member of any
    templated = _templates(source, distinct, percents, depth)
    own = distinct.where("n > 1").join(templated.select("h1", "h2"), ["h1", "h2"], "left_anti")
    members = stored(templated.unionByName(own.withColumns({"g1": F.col("h1"), "g2": F.col("h2")})), "members")

    # templates of two documents or more; where more are asked for, they are counted
    groups = members.groupBy("g1", "g2").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.coalesce(F.col("leaf") == SHORT, F.lit(False))).alias("short"))
    groups = stored(groups.where("low <> high").select("g1", "g2", "first", F.when(F.col("short"), short_docs).otherwise(min_docs).alias("need")), "groups")
    counted = _at_lines(occurrences.select(*_PLACE, "h1", "h2"), stored(members.select("h1", "h2", "n", "g1", "g2").join(groups.where("need > 2"), ["g1", "g2"]).drop("first"), "counted"))
    enough = counted.groupBy("g1", "g2", "need", "id", "th").agg(F.lit(1)).groupBy("g1", "g2", "need").agg(F.count("*").alias("docs")).where("docs >= need").select("g1", "g2")
    recurring = groups.where("need <= 2").unionByName(groups.where("need > 2").join(enough, ["g1", "g2"])).drop("need")

    going = stored(members.select("h1", "h2", "n", "g1", "g2").join(recurring, ["g1", "g2"]).select("h1", "h2", "n", "first"), "going")
    found = _at_lines(occurrences.select(*_PLACE, "h1", "h2"), going).where(~F.struct(*_PLACE).eqNullSafe(F.col("first")))
    return stored(found.groupBy("id", "th").agg(F.collect_set("pos").alias("gone")), "gone")


def _with_gone(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """The rows of `docs` as c0, c1, ..., with `old` (a text's lines) and `gone` (places of those that go, or null)."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gone = recurring_lines(source.withColumn("th", F.xxhash64("text")), **options)
    n, places = gone.agg(F.count("*"), F.sum(F.size("gone"))).first()
    size = 40 * n + 8 * (places or 0)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    text = F.col(f"c{docs.columns.index(text_col)}").cast("string")
    key = F.col(f"c{docs.columns.index(id_col)}").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("th"))
    chosen = small(gone, size)
    joined = rows.join(chosen if chosen is not gone else gone.hint("shuffle_hash"), key, "left").drop("id", "th")
    # a column of its own: within the expression that uses it, the text would be split again for each line
    return joined.withColumn("old", F.when(F.col("gone").isNotNull(), F.split(text, "\n", -1)))


def _shortened(text: Column) -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size("old") - 1), F.col("gone"))
    return F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda k: F.get(F.col("old"), k)), "\n"))


_DEFAULTS = {"depth": 3, "percents": PERCENTS, "min_docs": 2, "short_docs": 20, "min_tokens": 4, "min_chars": 24}


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs`, with its own columns only, without the lines that `dedup_lines` drops."""
    joined = _with_gone(docs, id_col, text_col, **_DEFAULTS | options)
    return joined.select(*((_shortened(F.col(f"c{i}")) if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with shortened texts, and n_lines and n_dropped (replacing columns of these names).

    Lines are what `\\n` separates, tokens what white space does. Options and their defaults: `depth` 3; `percents` (80, 60), the least shares of constant
    tokens, tried in this order (the last one also for a leaf's first template), of which two lie beyond the leading ones; `min_docs` 2;
    `short_docs` 20, the documents that a line of fewer than `min_tokens` 4 tokens and `min_chars` 24 code points (so
    that scripts without spaces have long lines too) must stand in. A line of digits only is no template and stays, as blank ones do.
    Repetition within one document does not count. The first
    document is the one with the smallest id (null first). Null texts stay null, an empty text stays empty, both with
    n_dropped 0; a text all of whose lines go becomes empty, and its row stays. Rows equal in id and text count as one
    document and get the same result. Equally heavy templates: the last by text. Other columns of any name are kept; an empty
    table gives no rows.
    """
    joined = _with_gone(docs, id_col, text_col, **_DEFAULTS | options)
    text = F.col(f"c{docs.columns.index(text_col)}").cast("string")
    added = {
        "n_lines": F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)),
        "n_dropped": F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")),
    }
    columns = [(_shortened(F.col(f"c{i}")) if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in added]
    return joined.select(*columns, *(v.cast("long").alias(k) for k, v in added.items()))


def _choice_sql(k: int, percent: int) -> str:
    """Common table expressions up to e<k> (line, template): the choice among the templates of one share of constant tokens."""
    return f"""
f{k} AS (SELECT * FROM {f"f{k - 1}" if k else "fs"} WHERE line NOT IN (SELECT line FROM e{k - 1 if k else "l"})),
w{k} AS (SELECT template, sum(cnt) AS w FROM f{k} WHERE agreed >= greatest((n * {percent} + 99) // 100, least(n, 5)) GROUP BY template HAVING count(*) > 1),
e{k} AS (SELECT line, arg_max(template, (w, template)) AS template FROM f{k} JOIN w{k} USING (template) WHERE agreed >= greatest((n * {percent} + 99) // 100, least(n, 5)) GROUP BY line)"""


#: The same rows in DuckDB's SQL, with the default parameters.
ORACLE = rf"""
WITH l AS (SELECT doc_id, i - 1 AS pos, trim(regexp_replace(regexp_replace(s[i], '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g'), '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
o AS (SELECT *, len(t) AS n, array_to_string(t[1:3], ' ') AS lead, len(t) < 4 AND length(line) < 24 AS short FROM (SELECT *, string_split(line, ' ') AS t FROM l WHERE replace(replace(line, '<*>', ''), ' ', '') <> '')),
d AS (SELECT line, any_value(n) AS n, any_value(lead) AS lead, any_value(t) AS t, count(*) AS cnt FROM o WHERE n > 5 GROUP BY line),
v AS (SELECT * FROM d WHERE (n, lead) IN (SELECT (n, lead) FROM d GROUP BY n, lead HAVING count(*) > 1)),
kl AS (SELECT n, lead, k, token, sum(cnt) AS w FROM (SELECT n, lead, cnt, unnest(t) AS token, unnest(range(1, n + 1)) AS k FROM v) GROUP BY ALL),
ml AS (SELECT n, lead, k, CASE WHEN 2 * max(w) > sum(w) THEN arg_max(token, w) ELSE '<*>' END AS token FROM kl GROUP BY n, lead, k),
pl AS (SELECT n, lead, list(token ORDER BY k) AS p FROM ml GROUP BY n, lead),
fl AS (SELECT v.line, array_to_string(p, ' ') AS template FROM v JOIN pl USING (n, lead) WHERE len(list_filter(range(1, v.n + 1), lambda i: v.t[i] = p[i] AND p[i] <> '<*>')) >= greatest((v.n * 60 + 99) // 100, least(v.n, 5))),
el AS (SELECT * FROM fl WHERE template IN (SELECT template FROM fl GROUP BY template HAVING count(*) > 1)),
re AS (SELECT *, least(n - greatest((n * 60 + 99) // 100, least(n, 5)) + 1, n - 3) AS nb FROM v WHERE line NOT IN (SELECT line FROM el)),
ba AS (SELECT line, n, cnt, t, concat(n, ' ', lead, ' ', band, ' ', array_to_string(t[4 + band * (n - 3) // nb : 3 + (band + 1) * (n - 3) // nb], ' ')) AS bucket FROM (SELECT *, unnest(range(nb)) AS band FROM re)),
sh AS (SELECT * FROM ba WHERE bucket IN (SELECT bucket FROM ba GROUP BY bucket HAVING count(*) > 1)),
ks AS (SELECT bucket, k, token, sum(cnt) AS w FROM (SELECT bucket, cnt, unnest(t) AS token, unnest(range(1, n + 1)) AS k FROM sh) GROUP BY ALL),
ms AS (SELECT bucket, k, CASE WHEN 2 * max(w) > sum(w) THEN arg_max(token, w) ELSE '<*>' END AS token FROM ks GROUP BY bucket, k),
ps AS (SELECT bucket, list(token ORDER BY k) AS p FROM ms GROUP BY bucket),
fs AS (SELECT DISTINCT * FROM (SELECT line, n, cnt, array_to_string(p, ' ') AS template, len(list_filter(range(1, n + 1), lambda i: t[i] = p[i] AND p[i] <> '<*>')) AS agreed FROM sh JOIN ps USING (bucket))),{",".join(_choice_sql(k, p) for k, p in enumerate(PERCENTS))},
g AS (SELECT doc_id, pos, short, coalesce(template, o.line) AS g FROM o LEFT JOIN (SELECT * FROM el {" ".join(f"UNION ALL SELECT * FROM e{k}" for k in range(len(PERCENTS)))}) USING (line)),
r AS (SELECT g, min((doc_id, pos)) AS first FROM g GROUP BY g HAVING count(DISTINCT doc_id) >= CASE WHEN bool_or(short) THEN 20 ELSE 2 END),
x AS (SELECT doc_id, list(pos) AS gone FROM g JOIN r USING (g) WHERE (doc_id, pos) <> first GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda e, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text,
  CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped
FROM documents a LEFT JOIN x USING (doc_id)
"""
