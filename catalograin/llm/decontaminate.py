"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index stores one posting (row, position) for every training token whose term any test phrase uses, plus each row's length as
the posting of an end mark; it is written where it is made, without a shuffle. A phrase is answered from its rarest
term's list: shifted by the term's offset it gives starts, which the second-rarest list thins out, and the lists of all other
terms confirm. Only lists of the two rarest terms, and postings of rows that still have a start, take part in a shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import small, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What a row of a few longs takes in a broadcast.
ROW_BYTES = 64
#: Words by which the terms of a phrase may lie apart from its rarest one to be near.
WITHIN = 15
_END = "\x00"  # no word has it


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _small(df: DataFrame, n: int) -> DataFrame:
    return small(df, ROW_BYTES * n)


class PositionalIndex:
    """Stored postings (uid, pos, term) of the terms in `vocabulary(term string)`; and `rows` (uid, id, th, n_words).

    th is the hash of a row's text. uid tells rows apart that repeat an id. `terms` maps a word to its number.
    """

    def __init__(self, docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        vocabulary = vocabulary.where(F.col("word").isNotNull()).select("word").distinct()
        self.terms = stored(vocabulary.select("word", (F.monotonically_increasing_id() + 1).alias("term")), "terms")
        self.n_terms, letters = self.terms.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
        numbered = self.terms.unionByName(docs.sparkSession.range(1).select(F.lit(_END).alias("word"), F.col("id").alias("term")))
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(F.monotonically_increasing_id().alias("uid"), "id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("words"))
        tokens = rows.select("uid", "id", "th", F.posexplode(F.array_append("words", F.lit(_END))).alias("pos", "word"))
        found = tokens.join(small(numbered, ROW_BYTES * self.n_terms + (letters or 0)), "word")
        self.all = stored(found.select("uid", F.when(F.col("term") == 0, F.col("id")).alias("id"), F.when(F.col("term") == 0, F.col("th")).alias("th"), "pos", "term"), "postings")
        self.postings = self.all.where("term > 0").select("uid", "pos", "term")
        self.rows = self.all.where("term = 0").select("uid", "id", "th", F.col("pos").cast("long").alias("n_words"))

    def frequencies(self) -> DataFrame:
        """(term, n) for every term that occurs."""
        return self.postings.groupBy("term").agg(F.count("*").alias("n"))

    def ranked(self, phrases: DataFrame) -> DataFrame:
        """(phrase, off, term, place, n_terms): the terms of each phrase, rarest first."""
        listed = phrases.select("phrase", F.size("words").alias("n_terms"), F.posexplode("words").alias("off", "word"))
        # both tables are small for a benchmark of usual size, so that a frequent word's rows are not dealt to one task
        counted = stored(self.terms.join(self.frequencies(), "term", "left").select("word", "term", F.coalesce("n", F.lit(0)).alias("n")), "counted")
        size = counted.agg(F.sum(F.octet_length("word"))).first()[0] or 0
        listed = listed.join(small(counted, ROW_BYTES * self.n_terms + size), "word")
        order = Window.partitionBy("phrase").orderBy("n", "off")
        return stored(listed.select("phrase", "off", "term", "n_terms", F.row_number().over(order).alias("place")), "ranked")

    def phrases(self, phrases: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
        """(phrase, uid, start, n_terms) for every exact occurrence of `phrases(phrase long, words array<string>)`.

        Phrases without words occur nowhere; each phrase number must stand once, its words all in the vocabulary. Their terms
        are ranked if that is not given.
        """
        ranked = self.ranked(phrases) if ranked is None else ranked
        first, second, rest = (ranked.where(c).drop("place") for c in ("place = 1", "place = 2", "place > 2"))
        n_first, n_second = first.count(), second.count()
        starts = self.postings.join(_small(first, n_first), "term")
        starts = starts.select("phrase", "uid", (F.col("pos") - F.col("off")).alias("start"), "n_terms").where("start >= 0")
        starts = stored(starts, "starts")

        # the second list, shifted: looked up at the place where each start needs it
        wanted = starts.where("n_terms > 1").join(_small(second.select("phrase", "off", "term"), n_second), "phrase")
        wanted = wanted.withColumn("pos", F.col("start") + F.col("off"))
        lists = self.postings.join(_small(second.select("term").distinct(), n_second), "term")
        thinned = wanted.join(lists, ["uid", "pos", "term"]).select("phrase", "uid", "start", "n_terms")
        left = stored(starts.where("n_terms = 1").unionByName(thinned), "starts")

        # the other lists, of the rows that still have a start
        rows = left.select("uid").distinct()
        n_rows, n_rest = rows.count(), rest.count()
        wanted = left.where("n_terms > 2").join(_small(rest.select("phrase", "off", "term"), n_rest), "phrase")
        wanted = wanted.withColumn("pos", F.col("start") + F.col("off"))
        lists = self.postings.join(_small(rows, n_rows), "uid")
        confirmed = wanted.join(lists, ["uid", "pos", "term"]).groupBy("phrase", "uid", "start", "n_terms").agg(F.count("*").alias("n"))
        confirmed = confirmed.where("n = n_terms - 2").drop("n")
        return stored(left.where("n_terms <= 2").unionByName(confirmed), "matches")

    def near(self, phrases: DataFrame, within: int, ranked: DataFrame | None = None) -> DataFrame:
        """(phrase, uid, pos): places of a phrase's rarest term with all its other terms at most `within` (1 or more) words away, in any order.

        Overlapping windows, and items of like wording, share their rarest terms, so places are looked at once for each pair of a rarest and a second-rarest
        term: those with the second one near stay. Around each place that stays all terms are gathered once, at most 2 * within + 1 of them,
        and the phrases of its pairs are held against that.
        """
        if within < 1:
            raise ValueError("within must be 1 or more")
        ranked = self.ranked(phrases) if ranked is None else ranked
        terms = ranked.groupBy("phrase", "term").agg(F.min("place").alias("place"))
        terms = terms.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("place", "term")))["term"].alias("terms"))
        known = stored(terms.select("phrase", "terms", F.col("terms")[0].alias("first"), F.coalesce(F.get("terms", F.lit(1)), F.col("terms")[0]).alias("second")), "terms")
        pairs = stored(known.select("first", "second").distinct(), "pairs")
        n_pairs, n_known = pairs.count(), known.count()
        firsts, seconds = (pairs.select(F.col(c).alias("term")).distinct() for c in ("first", "second"))

        # postings are cut into stretches of `within` words: what is near a place lies in its own or a neighbouring one
        stretch = F.floor(F.col("pos") / within)
        places = self.postings.join(_small(firsts, n_pairs), "term").select("uid", F.col("pos").alias("at"), F.col("term").alias("first"))
        single = places.join(_small(pairs.where("first = second"), n_pairs), "first")
        wanted = places.join(_small(pairs.where("first <> second"), n_pairs), "first").withColumn("stretch", F.explode(F.array(*(F.floor(F.col("at") / within) + k for k in (-1, 0, 1)))))
        lists = self.postings.join(_small(seconds, n_pairs), "term").select("uid", F.col("term").alias("second"), "pos", stretch.alias("stretch"))
        met = wanted.join(lists, ["uid", "second", "stretch"]).where(F.abs(F.col("at") - F.col("pos")) <= within).select("uid", "at", "first", "second").distinct()
        left = stored(single.select("uid", "at", "first", "second").unionByName(met), "places")

        rows = left.select("uid").distinct()
        n_rows = rows.count()
        around = left.select("uid", "at").distinct().withColumn("stretch", F.explode(F.array(*(F.floor(F.col("at") / within) + k for k in (-1, 0, 1)))))
        lists = self.postings.join(_small(rows, n_rows), "uid").withColumn("stretch", stretch)
        around = around.join(lists, ["uid", "stretch"]).where(F.abs(F.col("at") - F.col("pos")) <= within).groupBy("uid", "at").agg(F.collect_set("term").alias("there"))
        held = left.join(around, ["uid", "at"]).join(small(known, (ROW_BYTES + 160) * n_known), ["first", "second"])
        found = held.where(F.size(F.array_except("terms", "there")) == 0)
        return stored(found.select("phrase", "uid", F.col("at").alias("pos")), "near")


def windows(benchmark: DataFrame, width: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, words) of every window of `width` consecutive words; an item of fewer, but not none, is one window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("w"))
    last = F.greatest(F.size("w") - width, F.lit(0))
    items = items.where(F.size("w") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    return items.select("item", F.slice("w", F.col("at") + 1, F.lit(width)).alias("words")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", within: int | None = None) -> DataFrame:
    """Per row: the id, n_words, n_hit (words in any occurrence of a window), n_items, items_sha256, contaminated, and n_near if `within` is given (WITHIN is usual).

    n_near is the number of items with a window all of whose words stand, in any order, at most `within` words from an occurrence of
    the one of them that is rarest in `docs` (of equally rare ones, the first of the window).

    items_sha256 is the lowercase hex digest of the sorted item ids joined by commas (of "" for none). Null and empty texts have no
    words and no hits; null or wordless items have no window; a null item id counts in n_hit, but is no item. Repeated rows
    each get their result, null ids stay, and other columns of any name are ignored. An empty table of documents
    gives no rows; an empty benchmark marks nothing.
    """
    return _judged(docs, benchmark, width, id_col, text_col, item_col, item_text_col, within).drop("th")


def _judged(docs: DataFrame, benchmark: DataFrame, width: int, id_col: str, text_col: str, item_col: str, item_text_col: str, within: int | None = None) -> DataFrame:
    """The rows of `decontaminate`, n_near only if `within` is given, and th, the hash of a row's text."""
    listed = stored(windows(benchmark, width, item_col, item_text_col), "windows")
    phrases = stored(listed.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    index = PositionalIndex(docs, listed.select(F.explode("words").alias("word")), id_col, text_col)
    ranked = index.ranked(phrases)
    matches = index.phrases(phrases, ranked)
    hit = matches.select("uid", F.explode(F.sequence("start", F.col("start") + F.col("n_terms") - 1)).alias("pos")).distinct()
    hit = hit.groupBy("uid").agg(F.count("*").alias("n_hit"))
    owners = listed.join(phrases, "words").where(F.col("item").isNotNull()).select("phrase", "item")
    items = matches.select("phrase", "uid").distinct().join(owners, "phrase").groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    joined = index.rows.join(hit, "uid", "left").join(items, "uid", "left")
    near = []
    if within is not None:
        found = index.near(phrases, within, ranked).select("phrase", "uid").distinct().join(owners, "phrase")
        joined = joined.join(found.select("uid", "item").distinct().groupBy("uid").agg(F.count("*").alias("near")), "uid", "left")
        near = [F.coalesce("near", F.lit(0).cast("long")).alias("n_near")]
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *near, "th",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`docs` without the rows that hold a benchmark window; rows that repeat an id are told apart by text."""
    found = _judged(docs, benchmark, width, id_col, text_col, item_col, item_text_col)
    gone = stored(found.where("contaminated").select(F.col(id_col).alias("gone id"), F.col("th").alias("gone text")).distinct(), "gone")
    same = F.col(id_col).eqNullSafe(F.col("gone id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("gone text"))
    return docs.join(_small(gone, gone.count()), same, "left_anti")


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS k, array_to_string(w[s + 1 : s + 10], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, s, k, array_to_string(w[s + 1 : s + k], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.s, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.p = bw.p),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def near_oracle(within: int = WITHIN) -> str:
    """The same with n_near."""
    return f"""
WITH t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
bi AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
nw AS (SELECT DISTINCT item, w[s + 1 : s + 10] AS p FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM bi WHERE len(w) > 0)),
np AS (SELECT row_number() OVER () AS id, p FROM (SELECT DISTINCT p FROM nw)),
nt AS (SELECT id, word, min(off) AS off FROM (SELECT id, unnest(p) AS word, unnest(range(len(p))) AS off FROM np) GROUP BY id, word),
nf AS (SELECT word, count(*) AS n FROM t WHERE word IN (SELECT word FROM nt) GROUP BY word),
nr AS (SELECT id, arg_min(nt.word, (coalesce(n, 0), off)) AS rarest, count(*) AS k FROM nt LEFT JOIN nf USING (word) GROUP BY id),
na AS (SELECT id, k, doc_id, pos AS at FROM nr JOIN t ON t.word = nr.rarest),
nn AS (SELECT na.id, na.doc_id, na.at FROM na JOIN nt ON na.id = nt.id JOIN t ON t.doc_id = na.doc_id AND t.word = nt.word AND t.pos BETWEEN na.at - {within} AND na.at + {within} GROUP BY na.id, na.doc_id, na.at, na.k HAVING count(DISTINCT nt.word) = na.k),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM nn JOIN np ON nn.id = np.id JOIN nw ON nw.p = np.p GROUP BY doc_id),
x AS ({ORACLE})
SELECT x.*, coalesce(n_near, 0) AS n_near FROM x LEFT JOIN near USING (doc_id)
"""
