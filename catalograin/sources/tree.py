"""Pages as rows: one a node of their element tree, so that what lies inside what is a matter of numbers.

Nodes of a page are numbered in the order of their starts; `last` is the greatest number inside a node (its own if none). Node b is inside a if
a.pos < b.pos <= a.last. Text is a node of tag `#text`. Whatever asks about structure (selectors, cards, controls, crumbs) works on these rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements below this depth become children of the last one above it, as browsers do.
MAX_DEPTH = 512
#: Nodes, and numbers in their paths, that are handed on together.
BATCH_NODES, BATCH_PATHS = 20_000, 500_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text without markup; in the second sort, references are decoded.
RAW, RAW_DECODED = frozenset("script style noscript iframe template svg xmp".split()), frozenset("textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark q s samp select small span strike strong sub sup time tt u var wbr #text".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What a start tag closes if it is still open, and what keeps it from looking further up.
_ENDS = {
    **{b: (("p",), ("button", "td", "th", "table")) for b in BLOCKS},
    "li": (("li", "p"), ("ul", "ol", "table")),
    "dt": (("dt", "dd", "p"), ("dl", "table")),
    "dd": (("dt", "dd", "p"), ("dl", "table")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
#: Quotes count after `=` only. A tag without an end takes the rest of the page with it, so no text is looked at twice.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
SCHEMA = "pos int, last int, parent int, depth int, tag string, attrs map<string,string>, line int, text string, path array<int>"
_ARROW = {"pos": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "line": pa.int32(), "text": pa.string(), "path": pa.list_(pa.int32())}


def decoder(references: Sequence[str] | None) -> Callable[[str], str]:
    """What decodes the character references of a text: only those given, as written, the longest where several begin; None: all, with or without a semicolon."""
    if references is None:
        return entities.unescape
    known = re.compile("|".join(map(re.escape, sorted(references, key=len, reverse=True))) or "(?!)")
    return lambda text: known.sub(lambda m: entities.unescape(m[0]), text)


def nodes_of(html: str, decode: Callable[[str], str] = entities.unescape) -> list[list]:
    """The nodes of one page as rows of SCHEMA without path, in one pass; stray end tags are passed over, what is left open ends with the page."""
    nodes: list[list] = []
    stack: list[int] = []
    open_at: dict[str, list[int]] = {}  # where in the stack the elements of a name are
    blocks: list[int] = []  # and those that aren't inline
    line = 0

    def add(tag: str, attrs: list, text: str | None) -> int:
        pos = len(nodes)
        nodes.append([pos, pos, stack[-1] if stack else None, len(stack), tag, attrs, line, text])
        return pos

    def pop_to(size: int) -> None:
        while len(stack) > size:
            ended = nodes[stack.pop()]
            ended[1] = len(nodes) - 1
            open_at[ended[4]].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    def top(names: tuple) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        text = decode(html[at : m.start() if m else end])
        if text:
            add("#text", [], text)
        if not m or m.group(2) and not m.group(4):
            break
        at = m.end()
        closing, name, rest = m.group(1), m.group(2), m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            line += 1
        if closing:
            where = top((name,))
            if where >= 0 and not (name in INLINE and blocks and blocks[-1] > where):
                pop_to(where)
            continue
        closed, barriers = _ENDS.get(name, ((), ()))
        if (where := top(closed)) > top(barriers):
            # the outermost of those that end, such as an item around a paragraph
            pop_to(min(open_at[n][-1] for n in closed if open_at.get(n) and open_at[n][-1] > top(barriers)))
        attrs = {}
        for key, value in _ATTRIBUTE.findall(rest):
            attrs.setdefault(key.lower(), decode(value[1:-1] if value[:1] in "\"'" and value else value))
        pos = add(name, list(attrs.items()), None)
        if name in VOID or rest.endswith("/") and name in RAW:
            continue
        if name in RAW or name in RAW_DECODED:
            stop = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(html, at)
            body = html[at : stop.start() if stop else end]
            if body:
                nodes.append([pos + 1, pos + 1, pos, len(stack) + 1, "#text", [("type", attrs["type"])] if name == "script" and "type" in attrs else [], line, decode(body) if name in RAW_DECODED else body])
                nodes[pos][1] = pos + 1
            at = stop.end() if stop else end
        elif len(stack) < MAX_DEPTH:
            open_at.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append(pos)
    pop_to(0)
    return nodes


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", references: Sequence[str] | None = None) -> DataFrame:
    """(page_id, pos, last, parent, depth, tag, attrs, line, text, path) of every node of the pages; a null page has none.

    path: the numbers of the nodes around it, outermost first. line: nodes that no block's edge parts have the same. Text is as written, references decoded; that of
    a script has the script's type among its attributes. references: see `decoder`.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(references)
        for batch in batches:
            ids, rows, held = [], [], 0

            def told(ids, rows, type_=batch.schema.field(0).type):
                columns = [pa.array(ids, type_), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW.values()))]
                return pa.RecordBatch.from_arrays(columns, ["page_id", *_ARROW])

            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path: list[int] = []
                for node in nodes_of(html.as_py() or "", decode):
                    del path[node[3] :]
                    ids.append(page_id)
                    rows.append([*node, list(path)])
                    path.append(node[0])
                    held += len(path)
                    if len(rows) >= BATCH_NODES or held >= BATCH_PATHS:
                        yield told(ids, rows)
                        ids, rows, held = [], [], 0
            if rows:
                yield told(ids, rows)

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, {SCHEMA}")


# Selectors ------------------------------------------------------------------------------------------------------------------------------

_STEP = re.compile(r"""\s*([>,])\s*|(\s+)|([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*("[^"]*"|'[^']*'|[\w-]+)\s*(i)?\s*)?\]""")


def in_order():
    """A page's rows in the order of its nodes."""
    return Window.partitionBy("page_id").orderBy("pos")


def by_card():
    return Window.partitionBy("page_id", "card")


def _compound(found: list[tuple]) -> Column:
    attrs, test = F.col("attrs"), F.col("tag") != "#text"
    for tag, ident, cls, name, how, value, fold in found:
        if tag and tag != "*":
            test &= F.col("tag") == tag.lower()
        elif ident:
            test &= F.coalesce(attrs["id"] == ident, F.lit(False))
        elif cls:
            test &= F.array_contains(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), cls)
        elif name:
            have = attrs[name.lower()]
            value = value.strip("\"'")
            if fold:
                have, value = F.lower(have), value.lower()
            tests = {"": have.isNotNull(), "=": have == value, "*=": have.contains(value), "^=": have.startswith(value), "$=": have.endswith(value), "~=": F.array_contains(F.split(have, r"\s+"), value)}
            test &= F.coalesce(tests[how], F.lit(False))
    return test


def parse_selector(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives, each a list of (what parts it from the one before: `` none, ` ` inside, `>` child; parts of a compound selector)."""
    alternatives, steps, between, at = [], [], "", 0
    selector = selector.strip()
    while at < len(selector):
        m = _STEP.match(selector, at)
        if not m:
            raise ValueError(f"not a selector that is known here: {selector!r}")
        at = m.end()
        mark, space, *part = m.groups(default="")
        if mark == ",":
            alternatives.append(steps)
            steps, between = [], ""
        elif mark or space:
            between = mark or " "
        elif between or not steps:
            steps.append((between, [tuple(part)]))
            between = ""
        else:
            steps[-1][1].append(tuple(part))
    alternatives.append(steps)
    if between or not all(alternatives) or any(steps[0][0] for steps in alternatives):
        raise ValueError(f"not a selector that is known here: {selector!r}")
    return alternatives


def around(test: Column) -> Column:
    """Whether a node lies inside one that passes `test`: of those that start before it, the one that ends last has not ended. (A window by page.)"""
    return F.coalesce(F.max(F.when(test, F.col("last"))).over(in_order().rowsBetween(Window.unboundedPreceding, -1)) >= F.col("pos"), F.lit(False))


def holds(test: Column) -> Column:
    """Whether a node that passes `test` lies inside this one: the next such one starts before it ends. (A window by page.)"""
    return F.coalesce(F.min(F.when(test, F.col("pos"))).over(in_order().rowsBetween(1, Window.unboundedFollowing)) <= F.col("last"), F.lit(False))


def marked(nodes: DataFrame, selector: str, name: str) -> DataFrame:
    """`nodes` with a boolean column: whether a node is one that the selector chooses.

    Known are tags, `*`, `#id`, `.class`, `[a]`, `[a=v]` with `*= ^= $= ~=` and ` i`, inside (space), child (`>`) and lists; else ValueError.
    """
    out = []
    for n, steps in enumerate(parse_selector(selector)):
        here = None
        for k, (between, parts) in enumerate(steps):
            column, test = f"{name} {n} {k}", _compound(parts)
            if between == " ":
                nodes = nodes.withColumn(column, test & around(F.col(here)))
            elif between == ">":
                parents = nodes.where(F.col(here)).select(F.col("page_id").alias("parent's page"), F.col("pos").alias("parent's pos"))
                joined = nodes.join(parents, (F.col("page_id") == F.col("parent's page")) & (F.col("parent") == F.col("parent's pos")), "left")
                nodes = joined.withColumn(column, test & F.col("parent's pos").isNotNull()).drop("parent's page", "parent's pos")
            else:
                nodes = nodes.withColumn(column, test)
            here = column
        out.append(here)
    kept = [c for c in nodes.columns if not c.startswith(f"{name} ")]
    return nodes.select(*kept, reduce(lambda a, b: a | b, (F.col(f"`{c}`") for c in out)).alias(name))


# Text and links ---------------------------------------------------------------------------------------------------------------------------

_UNSEEN = ("script", "style", "noscript", "template", "svg", "head", "iframe")


def seen(nodes: DataFrame) -> DataFrame:
    """`nodes` without those that lie in scripts, styles and the like."""
    return nodes.withColumn("unseen", around(F.col("tag").isin(*_UNSEEN))).where("NOT unseen").drop("unseen")


def members(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """`nodes` with `root`, one row for each of `roots(page_id, pos)` that a node is or lies inside."""
    up = nodes.withColumn("root", F.explode(F.concat("path", F.array("pos"))))
    wanted = roots.select(F.col("page_id"), F.col("pos").alias("root")).distinct()
    return up.join(wanted.hint("merge"), ["page_id", "root"])


def texts(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, pos, text): what is to be read in each root: a line for each stretch that no block parts, white space collapsed, empty lines left out."""
    inside = members(nodes.where("tag = '#text'"), roots)
    lines = inside.groupBy("page_id", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "text"))).alias("t"))
    start = F.struct(F.lit(-1).alias("line"), F.array().cast("array<string>").alias("lines"))
    last = lambda a: F.element_at(a["lines"], -1)

    def put(a: Column, x: Column) -> Column:
        grown = F.concat(F.slice(a["lines"], 1, F.size(a["lines"]) - 1), F.array(F.concat(last(a), x["text"])))
        return F.struct(x["line"].alias("line"), F.when(a["line"] == x["line"], grown).otherwise(F.concat(a["lines"], F.array(x["text"]))).alias("lines"))

    clean = F.transform(F.aggregate("t", start, put)["lines"], lambda x: F.btrim(F.regexp_replace(x, r"[\s ]+", " ")))
    return lines.select("page_id", F.col("root").alias("pos"), F.array_join(F.filter(clean, lambda x: x != ""), "\n").alias("text"))


def text_content(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, pos, content): all text of each root as written."""
    inside = members(nodes.where("tag = '#text'"), roots).groupBy("page_id", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return inside.select("page_id", F.col("root").alias("pos"), F.array_join(F.col("t.text"), "").alias("content"))


def absolute(href: Column, base: Column) -> Column:
    """A link as an address: resolved against the page's, dot segments taken away; null without a link."""
    link = F.regexp_replace(href, r"^\s+|\s+$", "")
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(plain == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(plain, r"[^/]*$", ""))
    joined = (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link == "", F.regexp_extract(base, "^([^#]*)", 1))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), link))
        .when(link.startswith("?"), F.concat(plain, link))
        .otherwise(F.concat(folder, link))
    )
    head, path, rest = (F.regexp_extract(joined, r"^(https?://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    step = lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder_end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    dotted = F.concat(head, F.lit("/"), F.array_join(kept, "/"), folder_end, rest)
    whole = F.when(path == "", F.concat(head, F.lit("/"), rest)).when(path.rlike(r"/\.\.?(/|$)"), dotted).otherwise(joined)
    return F.when(head == "", joined).otherwise(whole)


def links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """`nodes` of links (`a` with href) with `here`, their page's address, and `href` as an address; pages: (page_id, url)."""
    found = nodes.where("tag = 'a' AND attrs['href'] IS NOT NULL").join(pages.select("page_id", F.col("url").alias("here")), "page_id")
    return found.withColumn("href", absolute(F.col("attrs")["href"], F.col("here")))
