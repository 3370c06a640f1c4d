"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels the spans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .storage import BATCH_BYTES, small, stored
from .wordbytes import blocks, give_back

MAX_TRAIN_ROWS = 20_000
#: Learned rows of this many words from which the floor of familiar text is taken; with fewer, there is none.
FLOOR_ROWS, FLOOR_WORDS = 100, 20
CACHE_WORDS = 150_000
BLOCK_CHARS = 1_500_000
UNKNOWN = "und"
#: First and last code point of the scripts that narrow the candidates. (Fixed values.)
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
OTHER = "Other"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower())


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    code = ord(next((c for c in word if c.isalpha()), word[0]))
    return next((name for name, spans in SCRIPTS.items() if any(lo <= code <= hi for lo, hi in spans)), OTHER)


def grams_of(word: str) -> list[str]:
    """Character trigrams of the word between marks, and the whole word."""
    marked = f"<{word}>"
    return [marked[i : i + 3] for i in range(len(marked) - 2)] + [marked]


def held_out(id_col: str = "doc_id"):
    """Whether a row is one of those that are never learned from: crc32(id as text) mod 4 is 2. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, kind, item, n): the trigrams and words (g) and the letters by script (s) of a batch of (lang, word, n)."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[lang, "s", script_of(word)] += n * len(word)
            for g in grams_of(word):
                counts[lang, "g", g] += n
        columns = list(zip(*counts, strict=True)) if counts else [[]] * 3
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(counts.values(), pa.int64())], ["lang", "kind", "item", "n"])


class Grams:
    """Places of learned trigrams and longer grams (whole words), looked up exactly in sorted arrays, which take a fifth of a dict's memory.

    A trigram's key is its three code points, which fit in 63 bits. A longer gram's is a hash; the gram found there is compared as text.
    """

    def __init__(self, names: pa.Array):
        """names: distinct grams of three code points or more. `places` has the place of each in turn, until it is taken away."""
        short = pc.equal(pc.utf8_length(names), 3).to_numpy(zero_copy_only=False)
        places = np.zeros(len(names), np.int64)
        keys = _trigram_keys("".join(names.filter(pa.array(short)).to_pylist()))[::3]
        order = np.argsort(keys, kind="stable")
        places[np.flatnonzero(short)[order]] = np.arange(len(keys))
        self.trigrams = keys[order]
        rest = names.filter(pa.array(~short))
        keys = _hashes(rest)
        order = np.argsort(keys, kind="stable")
        places[np.flatnonzero(~short)[order]] = len(self.trigrams) + np.arange(len(keys))
        self.longer, self.names = keys[order], rest.take(pa.array(order))
        self.places = places
        #: Most grams that share a hash.
        self.alike = int(np.unique(self.longer, return_counts=True)[1].max(initial=0))

    def __len__(self) -> int:
        return len(self.trigrams) + len(self.longer)

    def __contains__(self, gram: str) -> bool:
        return bool((self._trigrams(_trigram_keys(gram)) if len(gram) == 3 else self._longer(pa.array([gram], pa.string())))[0] >= 0)

    def _trigrams(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.trigrams, keys)
        found = at < len(self.trigrams)
        found[found] = self.trigrams[at[found]] == keys[found]
        return np.where(found, at, -1)

    def _longer(self, grams: pa.Array) -> np.ndarray:
        keys, out = _hashes(grams), np.full(len(grams), -1, np.int64)
        first = np.searchsorted(self.longer, keys)
        for k in range(self.alike):
            at = first + k
            rows = np.flatnonzero(at < len(self.longer))
            rows = rows[self.longer[at[rows]] == keys[rows]]
            same = pc.equal(grams.take(pa.array(rows)), self.names.take(pa.array(at[rows]))).to_numpy(zero_copy_only=False)
            out[rows[same]] = len(self.trigrams) + at[rows[same]]
        return out

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (-1: never seen) of the words' trigrams, word after word, the number of each word's, and places of the whole words; see `grams_of`."""
        size = np.array(list(map(len, words)), np.int64)  # trigrams of a word between marks: as many as its letters
        marked = [f"<{word}>" for word in words]
        before, starts = np.cumsum(size) - size, np.cumsum(size + 2) - size - 2
        trigrams = self._trigrams(_trigram_keys("".join(marked))[np.repeat(starts - before, size) + np.arange(size.sum())])
        one = size == 1
        whole = self._longer(pa.array(marked, pa.string()))
        whole[one] = trigrams[before[one]]
        return trigrams, size, whole


def _trigram_keys(text: str) -> np.ndarray:
    """A number for each three consecutive code points, another for any other three."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


def _hashes(grams: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(b.hashes(b.bounds[:-1], b.bounds[1:], lower=False) for b in blocks(grams))])


class Model:
    """Languages (sorted), log-probabilities per gram and language, which scripts each language uses, and how unfamiliar a text may be.

    Of each gram only the languages that have it are held, so many languages cost no more than what was learned of them.
    counts: arrays lang, kind, item, n. floor: the least familiarity (mean log-probability of a text's trigrams) of a known language.
    """

    def __init__(self, counts: pa.Table, languages: list[str]):
        self.languages, self.floor = sorted(languages), -np.inf
        place = {lang: i for i, lang in enumerate(self.languages)}
        n = len(self.languages)
        grams, scripts = counts.filter(pc.equal(counts["kind"], "g")), counts.filter(pc.equal(counts["kind"], "s"))
        items, langs = (pc.dictionary_encode(grams[k].combine_chunks().cast(pa.string())) for k in ("item", "lang"))
        self.gram = Grams(items.dictionary)
        gram = self.gram.places[items.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        del self.gram.places
        order = np.argsort(gram, kind="stable")
        lang = np.array([place[x] for x in langs.dictionary.to_pylist()], np.int32)
        self.lang = lang[langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)][order]
        times = grams["n"].to_numpy()[order].astype(np.float64)
        self.start = np.searchsorted(gram[order], np.arange(len(self.gram) + 1)).astype(np.int32)
        total = np.log(np.bincount(self.lang, times, n) + 0.5 * (len(self.gram) + 1)) if n else np.zeros(0)
        self.unseen = np.log(0.5) - total
        self.more = (np.log(times + 0.5) - np.log(0.5)).astype(np.float32)  # than for a gram never seen
        used: dict[str, np.ndarray] = {}
        for lang, item, c in zip(*(scripts[k].to_pylist() for k in ("lang", "item", "n")), strict=True):
            used.setdefault(item, np.zeros(n))[place[lang]] += c
        letters = sum(used.values(), np.zeros(n))
        self.allowed = {s: c >= 0.01 * np.maximum(letters, 1) for s, c in used.items()}

    def sums(self, owners: np.ndarray, grams: np.ndarray, n_words: int) -> np.ndarray:
        """(n_words, languages): the summed log-probabilities of grams (-1: never seen), each of an owner."""
        n = len(self.languages)
        known = grams >= 0
        at, owner = grams[known], owners[known]
        size = self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        flat = np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        seen = np.bincount(np.repeat(owner, size) * n + self.lang[flat], self.more[flat], n_words * n).reshape(n_words, n)
        return seen + np.bincount(owners, minlength=n_words)[:, None] * self.unseen


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """A model from at most about `max_rows` rows with text and language that are not held out.

    The rows are taken by a hash of the id, evenly by language, so that rare languages keep theirs. Every language, and every
    trigram and word of the whole texts taken, is learned. Half as far again below the median as one learned row in a thousand lies
    is the floor below which a text counts as of no learned language. No row to learn from: a model without languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    n = sizes.count()
    if not n:
        return Model(pa.table({"lang": [], "kind": pa.array([], pa.string()), "item": pa.array([], pa.string()), "n": []}), [])
    # of languages with fewer rows than their share, all are taken, and a rare one has one row at least in the mean
    share = (F.lit(1_000_000) * F.least(F.lit(1.0), F.lit(max_rows / n) / F.col("rows"))).cast("long").alias("share")
    shares = sizes.select("lang", share)
    sample = rows.join(small(shares, 60 * n), "lang").where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < F.col("share"))
    sample = sample.select("id", "text", "lang")
    met = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    met = met.groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = met.mapInArrow(_count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # what max_rows rows hold
    model = Model(table, pc.unique(table["lang"]).to_pylist())
    seen = stored(identify(sample, model, "id", spans=False).select("familiarity", "n_words").where(F.col("n_words") >= FLOOR_WORDS), "seen", BATCH_BYTES)
    n_seen, cuts = seen.agg(F.count("*"), F.percentile_approx("familiarity", F.array(F.lit(0.001), F.lit(0.5)), 10_000)).first()
    if n_seen >= FLOOR_ROWS:
        model.floor = cuts[0] - (cuts[1] - cuts[0]) / 2
    return model


class _Words(dict):
    """Numbers words as they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Labeller:
    """Scores words once each, and labels spans of texts."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, np.float32(penalty)
        self.n = len(model.languages)
        self._reset()

    def _reset(self) -> None:
        self.words = _Words()
        self.words.new = []
        self.scores = np.zeros((0, self.n), np.float32)
        self.familiar = np.zeros((0, self.n), np.float32)
        self.letters = np.zeros(0, np.int32)
        self.known = np.zeros(0, bool)

    def _learn(self) -> None:
        """Score the words met since."""
        new, self.words.new = self.words.new, []
        step = max(500, 20_000 // max(self.n, 4))
        for k in range(0, len(new), step):
            self._score(new[k : k + step])

    def _score(self, new: list[str]) -> None:
        trigrams, size, whole = self.model.gram.find(new)
        trigrams = self.model.sums(np.repeat(np.arange(len(new)), size), trigrams, len(new))
        whole = self.model.sums(np.arange(len(new)), whole, len(new))
        scores = (trigrams + whole) / 3  # overlapping grams say the same thing about thrice
        letters = np.array([sum(map(str.isalpha, word)) for word in new], np.int32)
        scripts = [script_of(word) for word in new]
        none = np.zeros(self.n, bool)
        allowed = np.array([self.model.allowed.get(s, none) for s in scripts]).reshape(len(new), self.n)
        known = allowed.any(1) & (letters > 0)
        if self.n:
            scores = np.where(allowed, scores - np.where(allowed, scores, -np.inf).max(1, keepdims=True, where=known[:, None], initial=-1e9), np.float32(-30))
        scores[~known] = 0
        self.scores = np.concatenate([self.scores, np.maximum(scores, -30).astype(np.float32)])
        self.familiar = np.concatenate([self.familiar, (trigrams / size[:, None]).astype(np.float32)])
        self.letters = np.concatenate([self.letters, letters])
        self.known = np.concatenate([self.known, known])

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and label of every word, text after text, and for each text (one more at the end) the words before it.

        Viterbi: a word's label costs its score, and a change of label the penalty. All texts go step by step together.
        """
        if len(self.words) > CACHE_WORDS:
            self._reset()
        number = self.words.__getitem__
        parts = [np.fromiter(map(number, words), np.int32, len(words)) for words in map(words_of, texts)]  # the words of one text at a time
        before = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        self._learn()
        labels = np.zeros(len(ids), np.int16)
        if self.n < 2 or not len(ids):
            return ids, labels, before
        order = np.argsort(-np.diff(before), kind="stable")
        starts, lengths = before[:-1][order], np.diff(before)[order]
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts with a word at each step
        best = np.zeros(len(ids), np.int16)
        stay = np.zeros((len(ids), self.n), bool)
        value = self.scores[ids[starts[: active[0]]]]
        for t in range(1, steps):
            m = active[t]
            value = value[:m]
            at = starts[:m] + t
            top = value.max(1, keepdims=True) - self.penalty
            best[at] = value.argmax(1)
            keep = value >= top
            stay[at] = keep
            value = np.where(keep, value, top)
            if t % 64 == 0:
                value = value - value.max(1, keepdims=True)
            value = value + self.scores[ids[at]]
            if m < len(labels) and (t + 1 == steps or active[t + 1] < m):
                gone = slice(active[t + 1] if t + 1 < steps else 0, m)
                labels[starts[gone] + t] = value[gone].argmax(1)
        single = slice(active[1] if steps > 1 else 0, active[0])
        labels[starts[single]] = self.scores[ids[starts[single]]].argmax(1)
        for t in range(steps - 1, 0, -1):
            at = starts[: active[t]] + t
            now = labels[at]
            labels[at - 1] = np.where(stay[at, now], now, best[at])
        return ids, labels, before


_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))


def _predict(model: Broadcast, penalty: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value, penalty)
        names, n = labeller.model.languages, labeller.n
        block_chars = max(20_000, BLOCK_CHARS * 4 // max(4, n))
        for batch in batches:
            texts, lang, score, changes, familiar, n_words, found = batch.column(batch.num_columns - 1), [], [], [], [], [], []
            # texts of like length go together: a block takes as many steps as its longest has words
            order = np.argsort(-pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), kind="stable")
            first = 0
            while first < len(texts):
                block, chars = [], 0
                while first + len(block) < len(texts) and (not block or chars < block_chars):
                    block.append(texts[int(order[first + len(block)])].as_py() or "")
                    chars += len(block[-1])
                first += len(block)
                ids, labels, before = labeller.label(block)
                letters = labeller.letters[ids]
                owner = np.repeat(np.arange(len(block)), np.diff(before))
                known = letters * labeller.known[ids]
                share = np.bincount(owner * max(n, 1) + labels, weights=known, minlength=len(block) * max(n, 1)).reshape(len(block), -1)
                total = np.bincount(owner, weights=letters, minlength=len(block))
                fit = np.bincount(owner, weights=known * labeller.familiar[ids, labels], minlength=len(block)) if n else np.zeros(len(block))
                fit = fit / np.maximum(np.bincount(owner, weights=known, minlength=len(block)), 1)
                familiar += fit.tolist()
                n_words += np.diff(before).tolist()
                top = share.argmax(1)
                lang += [names[k] if t and n else UNKNOWN for k, t in zip(top, total, strict=True)]
                score += (share.max(1) / np.maximum(total, 1)).tolist() if n else [0.0] * len(block)
                cut = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
                changes += np.bincount(owner[cut], minlength=len(block)).tolist()
                if spans:
                    ends = np.append(cut[1:], len(owner))[: len(cut)]
                    listed: list[list] = [[] for _ in block]
                    for c, e in zip(cut.tolist(), ends.tolist(), strict=True):
                        listed[owner[c]].append({"first_word": c - int(before[owner[c]]), "n_words": e - c, "lang": names[labels[c]] if n else UNKNOWN})
                    found += listed
            back = np.argsort(order)
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(changes, pa.int64()), pa.array(familiar, pa.float64()), pa.array(n_words, pa.int64()), *([pa.array(found, _SPANS)] if spans else [])]
            columns = [*batch.columns[:-1], *(c.take(pa.array(back)) for c in columns)]
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])
            del batch, texts, columns
        del labeller
        give_back()

    return run


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is known with at least `min_score` of their letters.

    Texts of FLOOR_WORDS words or more must also be as familiar as the model's floor asks for; shorter ones say too little of it.
    """
    numbered = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    text = f"c{docs.columns.index(text_col)}"
    found = identify(numbered, model, numbered.columns[0], text, spans=False, carry=numbered.columns[1:])
    familiar = (F.col("n_words") < FLOOR_WORDS) | (F.col("familiarity") >= float(model.floor))
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & familiar)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 6.0, spans: bool = True, carry: Sequence[str] = ()
) -> DataFrame:
    """Per row: the id, columns to carry, lang_pred, score, n_spans, familiarity, n_words and, if asked for, spans (first_word, n_words, lang) of its whole text.

    lang_pred is the language with most letters in its spans (ties: the first by name), score their share of all letters, familiarity
    the mean log-probability of the trigrams in the language of their span. Null texts and
    those without a letter are `und` with score 0 and no letters to share. Words of a script that no learned language uses are
    neutral, and their letters count for none. Repeated rows each get their result, null ids stay, an empty table gives none; without a learned
    language all are `und`. Other columns of any name are ignored.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(id_col, *carry, F.col(text_col).cast("string").alias("text of this row"))
    schema = StructType(rows.schema.fields[:-1]).add("lang_pred", "string").add("score", "double").add("n_spans", "long").add("familiarity", "double").add("n_words", "long")
    if spans:
        schema = schema.add("spans", ArrayType(StructType().add("first_word", "integer").add("n_words", "integer").add("lang", "string")))
    return rows.mapInArrow(_predict(broadcast, penalty, spans), schema)
