"""Quality rules: statistics of whole texts, judged by an isolation forest whose threshold comes from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small, stored
from .wordbytes import Block, blocks, runs

REPEAT_WIDTH = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
TREES, TREE_ROWS = 200, 256
#: Scores are rounded to so many digits, which bounds how many different ones there are.
SCORE_DIGITS = 5
#: Share of rows labelled good that the threshold may reject.
MAX_GOOD_LOSS = 0.002

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_EXTRA = ["n_chars", "n_letters", "n_digits", "n_upper", "n_lines", "n_distinct_words", "n_ends", "n_pipes"]
FEATURES = ["mean_word", "symbols", "dup_lines", "repeats", "letters", "digits", "upper", "distinct", "ends", "pipes", "words_per_line"]

_ASCII = np.zeros((256, 6), bool)  # symbol, digit, upper, letter, sentence end, bar
_ASCII[[ord(c) for c in "#*$%&|<>"], 0] = True
_ASCII[0x30:0x3A, 1] = True
_ASCII[0x41:0x5B, 2] = True
_ASCII[0x41:0x5B, 3] = _ASCII[0x61:0x7B, 3] = _ASCII[0xC0:, 3] = True
_ASCII[[ord(c) for c in ".!?"], 4] = True
_ASCII[ord("|"), 5] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags between each two bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def _equal_lines(block: Block, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines, and lines with a word that equal an earlier one."""
    cut = np.flatnonzero(block.data == 0x0A)
    texts = len(block.bounds) - 1
    begin = np.sort(np.concatenate([block.bounds[:-1], cut + 1]), kind="stable")
    owner = np.searchsorted(block.bounds[1:], cut, "right")
    n_lines = np.bincount(owner, minlength=texts) + (np.diff(block.bounds) > 0)
    # line k of a text: the text's begin, then each break's next byte; a line ends at its break or the text's end
    owners = np.sort(np.concatenate([np.arange(texts), owner]), kind="stable")
    end = np.empty(len(begin), np.int64)
    last = np.append(owners[1:] != owners[:-1], True)
    end[last] = block.bounds[1:]
    end[~last] = cut
    with_word = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, owners = begin[with_word], end[with_word], owners[with_word]
    hashes = block.hashes(begin, end, lower=False)
    order = np.lexsort((hashes, owners))
    same = (owners[order][1:] == owners[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return n_lines, np.bincount(owners[order][1:][same], minlength=texts)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of BASE and _EXTRA numbers per text of a batch."""
    out = np.zeros((len(texts), len(BASE) + len(_EXTRA)), np.int64)
    for block in blocks(texts):
        starts, stops, counts = block.words()
        n, bounds, data = len(block.bounds) - 1, block.bounds, block.data
        first = (data & 0xC0) != 0x80  # of a code point
        n_chars = _sums(first, bounds)
        inside = np.zeros(len(data) + 1, np.int64)
        inside[1:] = np.cumsum(first)
        n_words = np.diff(counts)
        chars = np.concatenate([[0], np.cumsum(inside[stops] - inside[starts])])
        word_chars = np.diff(chars[counts])
        hashes = block.hashes(starts, stops, lower=False)
        owner = np.repeat(np.arange(n), n_words)
        # words in windows found twice or more
        windows, before = runs(hashes, counts, REPEAT_WIDTH)
        of = np.repeat(np.arange(n), np.diff(before))
        full = np.repeat(n_words >= REPEAT_WIDTH, np.diff(before))
        order = np.lexsort((windows, of))
        equal = (of[order][1:] == of[order][:-1]) & (windows[order][1:] == windows[order][:-1])
        twice = np.zeros(len(windows), bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        at = (np.repeat(counts[:-1] - before[:-1], np.diff(before)) + np.arange(len(windows)))[twice & full]
        cover = np.zeros(len(hashes) + REPEAT_WIDTH + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + REPEAT_WIDTH, -1)
        n_repeat = _sums(np.cumsum(cover)[: len(hashes)] > 0, counts)
        n_lines, n_dup = _equal_lines(block, starts)
        order = np.lexsort((hashes, owner))
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        n_distinct = np.bincount(owner[order][fresh], minlength=n)
        kinds = [_sums(_ASCII[data, k], bounds) for k in range(6)]
        columns = [n_words, word_chars, kinds[0], n_dup, n_repeat, n_chars, kinds[3], kinds[1], kinds[2], n_lines, n_distinct, kinds[4], kinds[5]]
        out[block.rows.start : block.rows.stop] = np.stack(columns, 1)
    return out


def features(stats: np.ndarray) -> np.ndarray:
    """Rule statistics as shares, none of which grows with a text's length."""
    s = dict(zip(BASE + _EXTRA, stats.T.astype(np.float64), strict=True))
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([
        s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_letters"] / chars, s["n_digits"] / chars, s["n_upper"] / chars,
        np.log1p(s["n_distinct_words"]) / np.log1p(words), s["n_ends"] / words, s["n_pipes"] / words, np.log1p(words / lines),
    ], 1)


def base_failed(stats: np.ndarray) -> np.ndarray:
    n_words, n_repeat = stats[:, BASE.index("n_words")], stats[:, BASE.index("n_repeat_words")]
    return (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)


class IsolationForest:
    """Random splits of small samples; rows that few splits isolate score near 1, common rows below one half.

    Splits are drawn over the box that a node covers of `low` to `high`, not over its rows only, so that a value which no
    row of the sample has (but others do) is isolated too.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, nodes), np.int64)
        self.value = np.full((trees, nodes), np.inf)
        self.length = np.zeros((trees, nodes))
        self.usual = self._usual(size)
        for t in range(trees):
            sample = rows[rng.choice(len(rows), size, replace=False)] if size else rows
            self._grow(t, 0, sample, 0, low.copy(), high.copy(), rng)

    @staticmethod
    def _usual(n: int) -> float:
        """Mean path length of an unsuccessful search among n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, rows: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, rng) -> None:
        if depth < self.depth and len(rows) > 1 and (high > low).any():
            f = rng.choice(np.flatnonzero(high > low))
            cut = rng.uniform(low[f], high[f])
            self.feature[t, node], self.value[t, node] = f, cut
            right = rows[:, f] > cut
            below, above = high.copy(), low.copy()
            below[f] = above[f] = cut
            self._grow(t, 2 * node + 1, rows[~right], depth + 1, low, below, rng)
            self._grow(t, 2 * node + 2, rows[right], depth + 1, above, high, rng)
            return
        length = depth + self._usual(len(rows))
        below = [node]
        while below:  # a leaf's length holds wherever a row ends below it
            self.length[t, below] = length
            below = [c for b in below for c in (2 * b + 1, 2 * b + 2) if c < self.length.shape[1]]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, value, length in zip(self.feature, self.value, self.length, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[at, feature[node]] > value[node])
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual, 1e-9))


class Rules:
    """A forest over the good rows' statistics, and the score from which a row is an anomaly."""

    def __init__(self, forest: IsolationForest | None = None, threshold: float = np.inf):
        self.forest, self.threshold = forest, threshold

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores of rows of features, rounded to SCORE_DIGITS."""
        return np.round(self.forest.score(rows), SCORE_DIGITS) if self.forest is not None and len(rows) else np.zeros(len(rows))

    def keep(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anomaly scores, and whether rows stay."""
        scores = self.scores(features(stats))
        return scores, ~base_failed(stats) & (scores <= self.threshold)


def threshold_of(cuts: np.ndarray, good: np.ndarray, bad: np.ndarray, max_good_loss: float) -> float:
    """A cut between scores. `good` and `bad` say how many rows have each of the rising scores `cuts`.

    Of the scores above which no more good rows than allowed lie, the one that tells most bad rows from good ones.
    """
    if not len(cuts):
        return np.inf
    above = lambda n: 1 - np.cumsum(n) / max(n.sum(), 1) if n.sum() else np.ones(len(n))
    lost, caught = above(good), above(bad)
    best = int(np.argmax(np.where(lost <= max_good_loss, caught - lost, -np.inf)))
    return float((cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2) if caught[best] > lost[best] else np.inf


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_good_loss: float = MAX_GOOD_LOSS) -> Rules:
    """Rules from all labelled rows (quality 0 or 1).

    The ranges that splits are drawn over and the threshold come from every labelled row that the base rules leave. Each tree of the
    forest grows, as the method has it, over TREE_ROWS good rows, which are drawn from all of them by a hash of the id. What the driver
    gets is bounded: the trees' rows, and how many rows have each score.

    Rows without a text, an id or a quality are not used, nor ids labelled both ways; an id labelled twice counts once. Without
    good rows, only the base rules hold.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q"), F.max("quality").alias("other")).where("q = other").drop("other")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(small(labels, 48 * labels.count()), "id").select("text", F.col("q").cast("int"), F.xxhash64("id", F.lit("quality")).alias("h"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(0))
            judged = pa.array(~base_failed(stats))
            yield pa.RecordBatch.from_arrays([c.filter(judged) for c in (batch.column(1), batch.column(2), *(pa.array(c) for c in features(stats).T))], ["q", "h", *FEATURES])

    found = stored(rows.mapInArrow(measure, "q int, h long, " + ", ".join(f"{c} double" for c in FEATURES)), "measured")
    good = found.where("q = 1")
    n = good.count()
    if n < 2:
        return Rules()
    low, high = np.array(found.agg(*(F.min(c) for c in FEATURES), *(F.max(c) for c in FEATURES)).first(), float).reshape(2, -1)
    share = int(1_000_000 * min(1.0, 1.1 * TREES * TREE_ROWS / n))
    drawn = good.where(F.pmod("h", F.lit(1_000_000)) < share).select(*FEATURES).toPandas()
    drawn = drawn.sort_values(FEATURES).to_numpy(float)  # the forest must not depend on the order of tasks
    rules = Rules(IsolationForest(drawn, low, high, TREES, TREE_ROWS))
    broadcast = found.sparkSession.sparkContext.broadcast(rules)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = broadcast.value.scores(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["q", "score"])

    scored = found.select("q", *FEATURES).mapInArrow(score, "q int, score double").groupBy("score").agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") != 1).alias("bad")).toPandas().sort_values("score")
    rules.threshold = threshold_of(*(scored[c].to_numpy() for c in ("score", "good", "bad")), max_good_loss)
    return rules


def judge(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly.

    Words are `[^\\x20\\x09-\\x0D]+`. A row fails the base rules with fewer than 20 words, or when over 30 % of them lie in windows of
    8 words found twice or more; anomaly is the forest's score, and a row that passes the base rules is kept up to the
    threshold. Null and empty texts have no words and fail. Repeated rows and null ids stay; other columns of any name are
    ignored; an empty table gives no rows.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(rules)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(1))
            scores, kept = broadcast.value.keep(stats)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in stats.T[: len(BASE)]), pa.array(base_failed(stats)), pa.array(kept), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["id", *BASE, "base_failed", "kept", "anomaly"])

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
