"""Page snapshots: what a listing page says, from its HTML."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXT = 15_000
#: Characters of pages whose snapshots are held and handed on together, so a worker's memory does not follow the size of Spark's batches.
BLOCK_CHARS = 1_000_000
_HIDDEN = {"script", "style", "noscript", "template", "svg"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "br", "article", "section", "header", "footer", "nav", "main", "table", "dt", "dd"}
SCHEMA = "page_id long, url string, title string, h1 string, text string, links array<string>, og map<string,string>, ld_types array<string>, ld_price double"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.og, self.scripts, self.at = [], [], {}, [], []
        self.title = self.h1 = ""

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "a" and found.get("href"):
            self.links.append(found["href"])
        if tag == "meta" and (found.get("property") or "").startswith("og:"):
            self.og[found["property"][3:]] = found.get("content") or ""
        if tag == "script":
            self.scripts.append([found.get("type") or "", ""])
        if tag in _BLOCKS:
            self.parts.append("\n")
        if tag in _HIDDEN | {"title", "h1"}:
            self.at.append(tag)

    def handle_endtag(self, tag):
        if tag in self.at:
            del self.at[len(self.at) - 1 - self.at[::-1].index(tag) :]
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if "script" in self.at:
            self.scripts[-1][1] += data
        elif "title" in self.at:
            self.title += data
        elif not self.at or self.at[-1] not in _HIDDEN:
            if "h1" in self.at:
                self.h1 += data
            self.parts.append(data)


def _nodes(value) -> Iterator[dict]:
    """Every object of a JSON-LD body."""
    if isinstance(value, list):
        for v in value:
            yield from _nodes(v)
    elif isinstance(value, dict):
        yield value
        for v in value.values():
            yield from _nodes(v)


def _undecoded(html: str, references: Sequence[str]) -> str:
    """A page in which all character references but those named are escaped, so that they come out as written; scripts and styles stay."""
    others = re.compile(rf"<(script|style)\b.*?(?:</\1\s*>|\Z)|&(?!(?:{'|'.join(map(re.escape, references)) or '(?!)'});)", re.S | re.I)
    return others.sub(lambda m: m[0] if m[1] else "&amp;", html)


def snapshot(html: str, references: Sequence[str] | None = None) -> dict:
    page = _Page()
    page.feed(html if references is None else _undecoded(html, references))
    types, price = [], None
    for kind, body in page.scripts:
        if kind == "application/ld+json":
            try:
                nodes = list(_nodes(json.loads(body)))
            except ValueError:
                continue
            for n in nodes:
                t = n.get("@type")
                types += [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]
                if price is None and isinstance(n.get("price"), int | float | str) and re.fullmatch(r"\d+(\.\d+)?", str(n["price"])):
                    price = float(n["price"])
    lines: list[str] = []
    for line in "".join(page.parts).split("\n"):
        line = " ".join(line.split())
        if line and (not lines or lines[-1] != line):
            lines.append(line)
    clean = lambda s: " ".join(s.split()) or None
    return {"title": clean(page.title), "h1": clean(page.h1), "text": "\n".join(lines)[:MAX_TEXT], "links": page.links, "og": page.og, "ld_types": types, "ld_price": price}


def snapshots(pages: DataFrame, references: Sequence[str] | None = None) -> DataFrame:
    """(page_id, url, title, h1, text, links, og, ld_types, ld_price) of `pages(page_id, url, html)`; text has a line per block, at most MAX_TEXT characters.

    references: names of the only character references that are decoded, each up to its semicolon; None: all, with or without one.
    """

    types = {"links": pa.list_(pa.string()), "og": pa.map_(pa.string(), pa.string()), "ld_types": pa.list_(pa.string()), "ld_price": pa.float64()}
    names = ("title", "h1", "text", "links", "og", "ld_types", "ld_price")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, chars, rows = 0, 0, []
            for k, page in enumerate(batch.column(2)):
                page = page.as_py() or ""
                rows.append(snapshot(page, references))
                chars += len(page)
                if chars >= BLOCK_CHARS or k == batch.num_rows - 1:
                    columns = [pa.array([list(r[c].items()) if c == "og" else r[c] for r in rows], types.get(c, pa.string())) for c in names]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), batch.column(1).slice(at, len(rows)), *columns], ["page_id", "url", *names])
                    at, chars, rows = k + 1, 0, []

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, SCHEMA)


def page_kind(known_cards: Column, ld_types: Column, og_type: Column, listing_url: Column | bool = False, item_url: Column | bool = False) -> Column:
    """A page's kind: `listing` with ten known cards, or one at a known listing's address, or several products or a list; `item` at an item's address
    or with one product; `article`; else null (to be asked)."""
    products = F.size(F.filter(ld_types, lambda t: t.isin("Product", "Vehicle", "Car", "Offer")))
    flag = lambda c: c if isinstance(c, Column) else F.lit(c)
    return (
        F.when(known_cards >= 10, "listing")
        .when(flag(listing_url) & (known_cards >= 1), "listing")
        .when(flag(item_url), "item")
        .when((products >= 2) | F.arrays_overlap(ld_types, F.array(F.lit("ItemList"), F.lit("CollectionPage"))), "listing")
        .when((products == 1) | (og_type == "product"), "item")
        .when(F.arrays_overlap(ld_types, F.array(F.lit("Article"), F.lit("NewsArticle"))) | (og_type == "article"), "article")
    )


def class_names(pages: DataFrame, least: int = 3, top: int = 40) -> DataFrame:
    """(name, n): the most frequent class names of the pages' markup (a top-k)."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'class="([^"]*)"'), F.lit(1))).alias("c")).select(F.explode(F.split("c", r"\s+")).alias("name"))
    return found.where("name <> ''").groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(top)
