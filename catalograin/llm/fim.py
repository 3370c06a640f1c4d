"""Fill-in-middle: texts cut into units, then told as prefix, suffix and middle in one of two orders.

A unit grammar says between which neighbours a text may be cut, as pairs of character classes. It becomes one zero-width
regex of lookarounds, by which Spark's own `split` loses no code point: the pieces joined are the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cut lies where the code point before is of the first class and the one after of the second.
Grammar = tuple[tuple[str, str], ...]

_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
CODE_POINTS: Grammar = ((".", "."),)
#: Words and the spaces between them.
WORDS: Grammar = ((_WORD, _SPACE), (_SPACE, _WORD))
#: Words, each with the spaces before it.
SPACED_WORDS: Grammar = ((_WORD, _SPACE),)
#: Lines, each with its end.
LINES: Grammar = ((r"\n", "."),)

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = "<[PSM]>"


def boundary(grammar: Grammar) -> str:
    """The regex of the grammar's cuts; never within a pair of surrogates, as those are one code point."""
    pairs = "|".join(f"(?<={before})(?={after})" for before, after in grammar)
    return rf"(?s)(?:{pairs})(?<![\ud800-\udbff](?=[\udc00-\udfff]))"


def units(text: Column, grammar: Grammar) -> Column:
    """The pieces of `text`; an empty text has none, where `split` alone would say one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def hash_numbers(doc_id: Column, seed: str) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of `seed:doc_id`, as numbers. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made from. A mark can't be seen anew where it meets text, so it stands once only."""
    p = F.split(output, _MARKS, -1)
    psm, spm = F.concat(p[1], p[3], p[2]), F.concat(p[2], p[3], p[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, grammar: Grammar = CODE_POINTS, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, n (units), form, prefix, middle, suffix, output.

    With n units and the numbers h1 to h4 of the id's hash, the prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) units and the middle after the larger. A text is `plain` (its parts null, its output itself) if it is empty, if it
    contains a mark, or for `plain_percent` of the ids by h3; of the others `spm_percent` are `spm` by h4, the rest `psm`.
    A null text counts as empty, a null id as an empty one; repeated rows stay and are equal; an empty table gives no
    rows; other columns of any name are ignored. A row needs some 100 bytes a unit while it is worked on.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), units(text, grammar).alias("u"), F.array(*hash_numbers(F.col(id_col), seed)).alias("h"))
    n = F.size("u").cast("long")
    h = [F.col("h")[k] for k in range(4)]
    x, y = h[0] % (n + 1), h[1] % (n + 1)
    marked = F.col("text").rlike(_MARKS)
    form = F.when((n == 0) | marked | (h[2] % 100 >= 100 - plain_percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "u", n.alias("n"), F.least(x, y).cast("int").alias("i"), F.greatest(x, y).cast("int").alias("j"), form.alias("form"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("u", start, length), ""))

    i, j, size = F.col("i"), F.col("j"), F.col("n").cast("int")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(1), i).alias("prefix"), part(i + 1, j - i).alias("middle"), part(j + 1, size - j).alias("suffix"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def digests(rows: DataFrame) -> DataFrame:
    """Of rows of `fill_in_middle`: sizes and hashes; the text's is taken from what `output` restores."""
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: `digests(fill_in_middle(documents))` in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS h1, ('0x' || x[9:16])::BIGINT % (n + 1) AS h2, ('0x' || x[17:24])::BIGINT % 100 AS h3, ('0x' || x[25:32])::BIGINT % 100 AS h4 FROM d),
f AS (SELECT *, least(h1, h2) AS i, greatest(h1, h2) AS j, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, left(t, i) AS p, substring(t, i + 1, j - i) AS m, substring(t, j + 1, n - j) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
