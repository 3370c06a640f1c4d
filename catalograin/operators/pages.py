"""What a page's tree says: item cards, controls to further pages, breadcrumbs, class names, markup for a reader.

All of it works on the rows of `sources.tree.page_nodes`: selectors are windows over a page's nodes in order, membership is a join on a node's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import with_checkpoints
from ..sources.tree import VOID, absolute, around, holds, links, marked, members, seen, text_content, texts
from .state import card_url_scores

TITLES = "h1, h2, h3, h4, h5, h6, [class*=title i], [class*=name i]"
CONTAINERS = "li, article, [class*=card i], [class*=item i]"
FRAMES = "nav, header, footer"
TRAILS = '[aria-label*="breadcrumb" i], .breadcrumb, .breadcrumbs, [class*="breadcrumb" i]'
CARD_TEXT, CARD_TITLE = 1_000, 200
#: Words that stand beside a price. (Fixed values.)
CURRENCIES = r"(?i)(?<!\w)(KM|BAM|EUR|USD|GBP|CHF|RSD|HRK|kn|zł|Kč|Ft|lei)(?!\w)"


def _is_item(url: Column, here: Column) -> Column:
    """An address of the web that is not the page itself."""
    return F.coalesce(url.rlike("^https?:") & (url != here) & ~url.startswith(F.concat(here, F.lit("#"))), F.lit(False))


def _plain(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def _once(nodes: DataFrame) -> DataFrame:
    """Computed once, as what follows reads it several times; kept in the shared folder, so a lost executor costs nothing."""
    with_checkpoints(nodes.sparkSession)
    return nodes.checkpoint()


def _clean(text: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(text, r"\s+", " ")), 1, CARD_TITLE)


def _described(nodes: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page_id, card, url, title, text, image) of `chosen(page_id, card, url)`; nodes with `titled`, found: their links.

    The title is the first with words, not just a price: of the item link's title attribute, titles in the card, the link's text, and texts of
    images. The image is the first with an address of the web. Text is cut at CARD_TEXT characters.
    """
    roots = chosen.select("page_id", F.col("card").alias("pos"))
    inside = members(nodes.where("tag IN ('a', 'img') OR titled"), roots).where("root <> pos OR tag = 'a'")
    urls = found.select("page_id", "pos", "href", "here")
    inside = inside.join(urls, ["page_id", "pos"], "left").join(chosen.select("page_id", F.col("card").alias("root"), "url"), ["page_id", "root"])
    attrs = F.col("attrs")
    item = (F.col("tag") == "a") & (_plain(F.col("href")) == F.col("url"))
    read = texts(nodes, inside.where(item | F.col("titled")).select("page_id", "pos"))
    inside = inside.join(read.withColumnRenamed("text", "read"), ["page_id", "pos"], "left")
    ranks = F.array(
        F.struct(F.lit(1).alias("rank"), "pos", F.when(item, attrs["title"]).alias("name")),
        F.struct(F.lit(2).alias("rank"), "pos", F.when(F.col("titled") & (F.col("root") != F.col("pos")), F.col("read")).alias("name")),
        F.struct(F.lit(3).alias("rank"), "pos", F.when(item, F.col("read")).alias("name")),
        F.struct(F.lit(4).alias("rank"), "pos", F.when(F.col("tag") == "img", attrs["alt"]).alias("name")),
    )
    named = inside.select("page_id", "root", F.explode(ranks).alias("r")).select("page_id", "root", "r.rank", "r.pos", _clean(F.col("r.name")).alias("name"))
    named = named.where(F.regexp_replace("name", CURRENCIES, "").rlike(r"\p{L}{2,}")).groupBy("page_id", "root").agg(F.min_by("name", F.struct("rank", "pos")).alias("title"))
    here = found.select("page_id", "here").distinct()
    source = F.coalesce(F.nullif(attrs["src"], F.lit("")), attrs["data-src"])
    images = members(nodes.where("tag = 'img'"), roots).join(here, "page_id").withColumn("image", absolute(source, F.col("here"))).where(F.col("image").rlike("^https?:"))
    images = images.groupBy("page_id", "root").agg(F.min_by("image", "pos").alias("image"))
    whole = texts(nodes, roots).withColumnRenamed("pos", "root")
    out = chosen.withColumnRenamed("card", "root")
    for part in (named, images, whole):
        out = out.join(part, ["page_id", "root"], "left")
    return out.select("page_id", F.col("root").alias("card"), "url", F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("text", F.lit("")), 1, CARD_TEXT).alias("text"), "image")


def card_links(nodes: DataFrame, pages: DataFrame, selector: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links inside of cards as `card_url_scores` takes them, (page_id, cards) counts, all links, and the nodes with is_card and titled."""
    nodes = marked(marked(seen(nodes), selector, "is_card"), TITLES, "titled")
    nodes = _once(nodes.withColumns({"in_title": F.col("titled") | around(F.col("titled")), "has_image": holds(F.col("tag") == "img")}))
    found, boxes = links(nodes, pages), nodes.where("is_card")
    inner = members(found.withColumn("url", _plain(F.col("href"))).where(_is_item(F.col("url"), F.col("here"))), boxes).where("root <> pos")
    inner = inner.select("page_id", F.col("root").alias("card"), "pos", "url", "in_title", "has_image")
    return inner, boxes.groupBy("page_id").agg(F.count("*").alias("cards")), found, nodes


def cards(nodes: DataFrame, pages: DataFrame, selector: str, pattern: str | None = None) -> DataFrame:
    """(page_id, card, url, title, text, image) of each element that `selector` chooses and that leads to an item; pages: (page_id, url).

    A card that is a link itself leads there. Else the best link inside by `card_url_scores` wins, of equal ones the first.
    """
    inner, counts, found, nodes = card_links(nodes, pages, selector)
    own = found.where("is_card").where(_is_item(F.col("href"), F.col("here"))).select("page_id", F.col("pos").alias("card"), F.col("href").alias("url"))
    scored = card_url_scores(inner, pattern, counts)
    best = scored.groupBy("page_id", "card").agg(F.max_by("url", F.struct("score", -F.col("first"))).alias("url"))
    chosen = own.unionByName(best.join(own.select("page_id", "card"), ["page_id", "card"], "left_anti"))
    return _described(nodes, found, chosen)


def pattern_cards(nodes: DataFrame, pages: DataFrame, pattern: str) -> DataFrame:
    """As `cards`, without a selector: every link outside of frames whose address fits `pattern`, with the nearest element around it that looks like a card.

    Two links in one container are two rows.
    """
    nodes = marked(marked(marked(seen(nodes), TITLES, "titled"), CONTAINERS, "holds_card"), FRAMES, "frame")
    nodes = _once(nodes.withColumn("framed", F.col("frame") | around(F.col("frame"))))
    found = links(nodes, pages)
    fitting = found.where("NOT framed").where(_is_item(F.col("href"), F.col("here")) & F.col("href").rlike(pattern))
    boxed = members(fitting, nodes.where("holds_card")).groupBy("page_id", "pos").agg(F.max("root").alias("box"))
    fitting = fitting.join(boxed, ["page_id", "pos"], "left").select("page_id", F.col("pos").alias("link"), F.coalesce("box", "pos").alias("card"), F.col("href").alias("url"))
    told = _described(nodes, found, fitting.select("page_id", "card", "url").distinct())
    return fitting.join(told, ["page_id", "card", "url"]).select("page_id", "card", "url", "title", "text", "image")


def controls(nodes: DataFrame, pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, here, pos, rel, label, cls, href, disabled) of each element that `selector` chooses, as `navigation.next_control` takes them.

    pos counts the page's controls from 0. A link around a control counts with it.
    """
    nodes = _once(marked(nodes, selector, "chosen"))
    chosen = nodes.where("chosen")
    anchors = nodes.where("tag = 'a'").select("page_id", F.col("pos").alias("a_pos"), F.col("attrs").alias("a"))
    nearest = members(chosen, anchors.select("page_id", F.col("a_pos").alias("pos"))).groupBy("page_id", "pos").agg(F.max("root").alias("a_pos"))
    rows = chosen.join(nearest, ["page_id", "pos"], "left").join(anchors, ["page_id", "a_pos"], "left").join(text_content(nodes, chosen), ["page_id", "pos"], "left")
    rows = rows.join(pages.select("page_id", F.col("url").alias("here")), "page_id")
    attrs, a = F.col("attrs"), F.col("a")
    said = lambda *names: F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in names))
    off = attrs["disabled"].isNotNull() | (attrs["aria-disabled"] == "true") | attrs["class"].rlike(r"(?i)\bdisabled\b")
    place = (F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1).alias("pos")
    return rows.select(
        "page_id", "here", place, said(attrs["rel"], a["rel"]).alias("rel"),
        said(F.col("content"), attrs["aria-label"], attrs["title"], a["aria-label"], a["title"]).alias("label"),
        said(attrs["class"], a["class"]).alias("cls"), absolute(a["href"], F.col("here")).alias("href"), F.coalesce(off, F.lit(False)).alias("disabled"),
    )


def trail_crumbs(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, position, name, url): the links of each page's first breadcrumb trail, in order from 1."""
    nodes = _once(marked(nodes, TRAILS, "trail"))
    first = nodes.where("trail").groupBy("page_id").agg(F.min("pos").alias("pos"))
    inside = members(links(nodes, pages), first)
    read = text_content(nodes, inside)
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).alias("position")
    rows = inside.join(read, ["page_id", "pos"], "left")
    return rows.select("page_id", place, F.btrim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")).alias("name"), F.col("href").alias("url"))


def frequent_classes(nodes: DataFrame, least: int = 3, top: int = 40) -> DataFrame:
    """(page_id, name, n): the class names that at least `least` elements of a page have, its `top` most frequent (a top-k, ties by name)."""
    names = nodes.select("page_id", F.explode(F.split(F.col("attrs")["class"], r"\s+")).alias("name")).where("name <> ''")
    counted = names.groupBy("page_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "name"))
    return counted.withColumn("place", place).where(F.col("place") <= top).drop("place")


# Markup for a reader ----------------------------------------------------------------------------------------------------------------------

#: What stays of a page for the reader that looks for its structure. (Fixed values.)
KEPT_TAGS = "html body div span section article main header footer nav ul ol li a img h1 h2 h3 h4 h5 h6 p table thead tbody tr td th button strong em b i figure".split()
KEPT_ATTRIBUTES = {"a": ["href", "class", "id", "rel", "aria-label"], "img": ["src", "alt", "class"], "button": ["class", "id", "type", "aria-label", "disabled"]}
EVERYWHERE = ["class", "id"]
DROPPED = ["script", "style", "noscript", "svg", "iframe", "canvas", "video", "audio", "head", "template"]
MARKUP_CHARS, TAIL_CHARS = 200_000, 40_000


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sanitised(nodes: DataFrame, most: int | None = MARKUP_CHARS) -> DataFrame:
    """(page_id, markup): each page with only those tags and attributes that show its structure, white space collapsed, every element closed.

    Contents of scripts, the head and the like go; of other tags that go, the content stays. Links keep addresses of the web and relative ones.
    Of a page of more than `most` characters its head and tail stay; None: all of it. A page without any node has no row.
    """
    kept = nodes.withColumn("dropped", F.col("tag").isin(*DROPPED) | around(F.col("tag").isin(*DROPPED))).where("NOT dropped")
    kept = kept.where(F.col("tag").isin("#text", *KEPT_TAGS))
    name_of = {tag: [*names, *(n for n in EVERYWHERE if n not in names)] for tag, names in KEPT_ATTRIBUTES.items()}
    by_tag = F.create_map(*[x for tag, names in name_of.items() for x in (F.lit(tag), F.array(*map(F.lit, names)))])
    mine = F.coalesce(by_tag[F.col("tag")], F.array(*map(F.lit, EVERYWHERE)))
    harmless = lambda e: ~e["key"].isin("href", "src") | ~e["value"].rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | e["value"].rlike("(?i)^https?:")
    attrs = F.filter(F.map_entries("attrs"), lambda e: F.array_contains(mine, e["key"]) & harmless(e))
    told = F.array_join(F.transform(attrs, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(_escaped(e["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    void = F.col("tag").isin(*(VOID & set(KEPT_TAGS)))
    start = F.when(F.col("tag") == "#text", _escaped(F.col("text"))).otherwise(F.concat(F.lit("<"), "tag", told, F.when(void, " />").otherwise(">")))
    end = F.when((F.col("tag") != "#text") & ~void, F.concat(F.lit("</"), "tag", F.lit(">")))
    # a start stands at its number; an end behind all that is inside, of ends at one place the innermost first
    marks = F.array(F.struct(F.col("pos").alias("at"), F.lit(0).alias("end"), F.lit(0).alias("up"), start.alias("s")), F.struct(F.col("last").alias("at"), F.lit(1).alias("end"), (-F.col("depth")).alias("up"), end.alias("s")))
    page = kept.select("page_id", F.explode(F.filter(marks, lambda m: m["s"].isNotNull())).alias("m")).groupBy("page_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    joined = F.regexp_replace(F.array_join(F.col("m.s"), ""), r"\s+", " ")
    text = F.btrim(F.regexp_replace(joined, "> <", "><"))
    if most is None:
        return page.select("page_id", text.alias("markup"))
    short = F.concat(F.substring(text, 1, most - TAIL_CHARS), F.lit("<!--truncated-->"), F.right(text, F.lit(TAIL_CHARS)))
    return page.select("page_id", F.when(F.length(text) > most, short).otherwise(text).alias("markup"))
