"""HTML extraction by a maximum-scoring subsequence of words (positive) and tags (negative).

Weights, and which names of elements and classes stand for menus, adverts and the like, are learned from pages that mark their main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRAIN_ROWS = 2_000
#: Weights of words and tags in surroundings that no labelled page has.
NEW_WORD, NEW_TAG = 0.5, -1.0

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>?|[^<]+|<""",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
_KIND = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>]*)""", re.I)
#: Elements that lie within a line of text, so no space stands for their tags.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Blocks that main text may well have, even if no labelled page shows it; their tags and inline ones never cost more than WEAKEST_BREAK.
TEXTUAL = frozenset("blockquote br caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr img li ol p pre table tbody td th thead tr ul".split())
WEAKEST_BREAK = -4.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is usually not main text, and words of which a class, id or role consists if its content is not. Both are where learning
#: starts from: what labelled pages say of a name outweighs it.
OUT_ELEMENTS = frozenset("nav header footer aside form button dialog menu head".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted related reply replies respond responses share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
PLAIN_WORDS = frozenset("area bar block bottom box container content fixed global inner left list main outer page post posts right section site sticky top user wrap wrapper".split())
#: Words that a name counts as having inside and outside main text before any page is seen, and the odds below which its content goes.
USUAL, UNUSUAL, LEAST_ODDS = (20, 1), (1, 20), 0.1
#: An element goes only if what is left of the page has at least this part of its words.
LEAST_LEFT = 0.1


class Piece:
    """A stretch of text or a tag. key: the tag's name and class, or for text that of the element around it; out: below an element that is not main text."""

    __slots__ = ("text", "key", "out", "name", "closing", "element")

    def __init__(self, text: str | None, key: str, element: int, name: str = "", closing: bool = False):
        self.text, self.key, self.out, self.name, self.closing, self.element = text, key, False, name, closing, element


class Element:
    """start, stop: its first piece, and the one after its last."""

    __slots__ = ("parent", "name", "names", "key", "words", "framing", "out", "start", "stop")

    def __init__(self, parent: int, name: str, names: list[str], key: str, start: int):
        self.parent, self.name, self.names, self.key, self.words, self.framing, self.out, self.start, self.stop = parent, name, names, key, 0, False, False, start, start + 1


def _unusual(name: str) -> bool:
    """Whether a name (an element's in angle brackets) is usual for what is not main text."""
    if name[0] == "<":
        return name[1:] in OUT_ELEMENTS
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    return any(w in OUT_WORDS for w in words) and all(w in OUT_WORDS or w in PLAIN_WORDS for w in words)


def goes(name: str, inside: int = 0, outside: int = 0) -> bool:
    """Whether the content of elements of a name goes, after so many words seen inside and outside main text.

    Elements that are not in OUT_ELEMENTS never go by their own name, as main text may be in any of them.
    """
    unusual = _unusual(name)
    if name[0] == "<" and not unusual:
        return False
    a, b = UNUSUAL if unusual else USUAL
    return (inside + a) / (outside + b) < LEAST_ODDS


def parsed(page: str, gone: Callable[[str], bool] = goes) -> tuple[list[Piece], list[Element]]:
    """The page's texts (references decoded) and tags, in order, without scripts, styles and the like; and its elements.

    Texts and tags in elements with a name that goes are `out`, unless the element is around the main text: around an `article` or
    `main`, or around so much that less than LEAST_LEFT of its words would be left outside such elements.
    """
    found: list[Piece] = []
    elements = [Element(-1, "", [], "", 0)]
    stack = [0]
    open_at: dict[str, list[int]] = {}  # where in the stack the elements of a name are
    framed = 0  # so many of the stack are known to be around main text

    def end(size: int) -> None:
        nonlocal framed
        while len(stack) > size:
            ended = elements[stack.pop()]
            ended.stop = len(found)
            if stack:
                open_at[ended.name].pop()
        framed = min(framed, len(stack))

    for m in _TOKEN.finditer(page):
        raw = m.group()
        if raw[0] != "<" or raw == "<":
            at = elements[stack[-1]]
            found.append(Piece(html.unescape(raw), at.key, stack[-1]))
            at.words += len(found[-1].text.split())
            continue
        if m.group(1) or raw[1] in "!?":
            if m.group(1):
                found.append(Piece(None, "script", -1, m.group(1).lower()))
            continue
        name = _NAME.match(raw).group(1).lower()
        if raw[1] == "/":
            at = open_at[name][-1] if open_at.get(name) else None
            element = stack[at] if at is not None else stack[-1]
            found.append(Piece(None, "/" + (elements[element].key if at is not None else name), element, name, True))
            if at is not None:
                end(at)
            continue
        names = [n for kind in _KIND.findall(raw) for n in kind.lower().split()]
        words = re.split(r"[^a-z0-9]+", names[0]) if names else [""]
        key = f"{name}.{words[0]}" if words[0] else name
        elements.append(Element(stack[-1], name, [f"<{name}", *names], key, len(found)))
        found.append(Piece(None, key, len(elements) - 1, name))
        if name in ("article", "main"):
            for i in stack[framed:]:
                elements[i].framing = True
            framed = len(stack)
        if name not in VOID and not raw.endswith("/>"):
            open_at.setdefault(name, []).append(len(stack))
            stack.append(len(elements) - 1)
    end(0)
    _mark(elements, gone)
    for piece in found:
        piece.out = piece.element < 0 or elements[piece.element].out
    return found, elements


def _sums(elements: list[Element]) -> list[int]:
    """Words of each element with all that is inside."""
    whole = [e.words for e in elements]
    for i in range(len(elements) - 1, 0, -1):
        whole[elements[i].parent] += whole[i]
    return whole


def _mark(elements: list[Element], gone: Callable[[str], bool]) -> None:
    """Mark the elements that go, from the outermost inwards."""
    whole = _sums(elements)
    in_article = [False] * len(elements)
    inside = [False] * len(elements)  # of one that would go by its name
    wanted = [False] * len(elements)
    known: dict[str, bool] = {}
    left = whole[0]
    for i, e in enumerate(elements[1:], 1):
        in_article[i] = e.name == "article" or in_article[e.parent]
        for name in e.names:
            if name not in known:
                known[name] = gone(name)
        wanted[i] = not e.framing and e.name not in ("html", "body", "article", "main") and not (e.name == "header" and in_article[i]) and any(map(known.get, e.names))
        inside[i] = inside[e.parent] or wanted[i]
        if wanted[i] and not inside[e.parent]:
            left -= whole[i]
    lost = [0] * len(elements)  # words in those within an element that would go
    for i in range(len(elements) - 1, 0, -1):
        lost[elements[i].parent] += whole[i] if wanted[i] else lost[i]
    for i, e in enumerate(elements[1:], 1):
        if elements[e.parent].out:
            e.out = True
        elif wanted[i]:
            if left < LEAST_LEFT * whole[i]:  # it is around the main text: what it has outside of others that go is left
                left += whole[i] - lost[i]
            else:
                e.out = True


def label(page: str, gone: Callable[[str], bool] = goes) -> tuple[list[tuple[Piece, bool]], Counter, Counter] | None:
    """Pieces that do not go, with whether they lie in the page's one `article` element; and the words by name of elements inside and outside it.

    None if the page has none or several. Names of elements around the article are not counted.
    """
    found, elements = parsed(page, gone)
    opens = [i for i, p in enumerate(found) if p.name == "article" and not p.closing]
    closes = [i for i, p in enumerate(found) if p.name == "article" and p.closing]
    if len(opens) != 1 or len(closes) != 1 or closes[0] < opens[0]:
        return None
    article, inside, outside = found[opens[0]].element, Counter(), Counter()
    within = [i == article for i in range(len(elements))]
    for i, (e, n) in enumerate(zip(elements, _sums(elements), strict=True)):
        within[i] |= i > 0 and within[e.parent]
        if i and n and i != article and not e.framing:
            into = inside if within[i] else outside
            for name in e.names:
                into[name] += n
    return [(p, opens[0] < i < closes[0]) for i, p in enumerate(found) if not p.out], inside, outside


class Weights:
    """Scores of words (by the element around them) and tags, as log-odds of lying inside main text; and the names of elements that go."""

    def __init__(self, counts: dict[tuple[str, str], tuple[int, int]]):
        self.words: dict[str, float] = {}
        self.tags: dict[str, float] = {}
        self.names: dict[str, bool] = {}
        for (kind, key), (inside, outside) in counts.items():
            odds = math.log((inside + 0.5) / (outside + 0.5))
            if kind == "w":
                self.words[key] = min(2.0, max(0.02, 1 + odds / 2))
            elif kind == "n":
                self.names[key] = goes(key, inside, outside)
            else:
                least = WEAKEST_BREAK if key.lstrip("/").partition(".")[0] in INLINE | TEXTUAL else -math.inf
                self.tags[key] = -0.02 if odds > 0 else max(least, -2.0 + 3 * odds)

    def word(self, key: str) -> float:
        """The score of a word; with a class that no labelled page has, that of the element without one."""
        return self.words.get(key, self.words.get(key.partition(".")[0], NEW_WORD))

    def tag(self, key: str) -> float:
        return self.tags.get(key, self.tags.get(key.partition(".")[0], NEW_TAG))

    def gone(self, name: str) -> bool:
        if name not in self.names:
            return goes(name)
        return self.names[name]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inside, outside = Counter(), Counter()
        for page in batch.column(0).to_pylist():
            labelled = label(page)
            if labelled is None:
                continue
            for piece, within in labelled[0]:
                into = inside if within else outside
                if piece.text is None:
                    into["t", piece.key] += 1
                elif n := len(piece.text.split()):
                    into["w", piece.key] += n
            for into, names in ((inside, labelled[1]), (outside, labelled[2])):
                into.update({("n", name): n for name, n in names.items()})
        keys = sorted(inside.keys() | outside.keys())
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "inside", "outside"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_rows: int = MAX_TRAIN_ROWS) -> Weights:
    """Weights from at most about `max_rows` of the pages that mark their main text by one `article`, taken by a hash of the id.

    Counts are added up over whole pages, and all surroundings and names that these pages have are kept. Without such pages, all
    weights are the defaults.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    pages = pages.where(F.regexp_count("html", F.lit(r"(?i)<article[\s>]")) == 1)
    share = int(1_000_000 * min(1.0, max_rows / max(pages.count(), 1)))
    sample = pages.where(F.pmod(F.xxhash64("id", F.lit("pages")), F.lit(1_000_000)) < share)
    counts = sample.select("html").mapInArrow(_count, "kind string, key string, inside long, outside long").groupBy("kind", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return Weights({(r["kind"], r["key"]): (r["inside"], r["outside"]) for r in counts.collect()})  # what max_rows pages hold


def best_stretch(scores: Iterable[float]) -> tuple[int, int]:
    """Where the contiguous scores with the largest sum begin and end (exclusive), by one scan; (0, 0) if no sum is positive.

    Of equally good ones, the one that ends first, and of those the longest: it begins before scores that sum to 0.
    """
    total, least, start, best, found = 0.0, 0.0, 0, 0.0, (0, 0)
    for i, score in enumerate(scores):
        total += score
        if total < least:
            least, start = total, i + 1
        elif total - least > best:
            best, found = total - least, (start, i + 1)
    return found


def _whole_articles(found: list[Piece], elements: list[Element], start: int, stop: int) -> tuple[int, int]:
    """The region, grown by the rest of each `article` (and `main` without one) that it lies in or has half the words of: tags that no labelled page has cost too much there."""
    words = [0]
    for piece in found:
        words.append(words[-1] + (len(piece.text.split()) if piece.text is not None and not piece.out else 0))
    parted = set()
    for e in reversed(elements):
        if e.name == "article" and e.parent >= 0:
            parted.add(e.parent)
    around = [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        around[i] |= i in parted
        around[elements[i].parent] |= around[i]
    for i, e in enumerate(elements):
        if not e.out and (e.name == "article" or e.name == "main" and not around[i]):
            mine, common = words[e.stop] - words[e.start], words[max(start, min(stop, e.stop))] - words[min(stop, max(start, e.start))]
            if common and (2 * common >= mine or common == words[stop] - words[start]):
                start, stop = min(start, e.start), max(stop, e.stop)
    return start, stop


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best contiguous region, with the rest of the article that it lies in; elements that are not main text weigh nothing and go."""
    found, elements = parsed(page or "", weights.gone)

    def score(piece: Piece) -> float:
        if piece.out:
            return 0.0
        if piece.text is None:
            return weights.tag(piece.key)
        return len(piece.text.split()) * weights.word(piece.key)

    start, stop = _whole_articles(found, elements, *best_stretch(map(score, found)))
    parts = []
    for piece in found[start:stop]:
        if piece.text is None:
            if piece.name not in INLINE:
                parts.append(" ")
        elif not piece.out:
            parts.append(piece.text)
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (main text of the whole page), n_chars (its code points).

    Null and empty pages, and pages without words, give an empty text. White space is one space, also between blocks. Repeated rows
    and null ids or urls stay; other columns of any name are ignored; an empty table gives no rows. Of equally good regions the first counts.
    """
    broadcast = pages.sparkSession.sparkContext.broadcast(weights)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), broadcast.value) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
