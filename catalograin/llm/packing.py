"""Best-fit packing: sum-of-squares bins over the token counts of tokenised documents."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import BATCH_BYTES, stored
from .wordbytes import give_back

if TYPE_CHECKING:
    import pandas as pd

CAPACITY = 4096
#: Pieces that one task packs; beyond, more tasks do. Each leaves a handful of part-filled bins, which the next level packs again.
CHUNK_PIECES = 50_000
#: Share of a level's pieces in bins it leaves open, beyond which their bins stay as they are.
MOST_LEFT = 0.75
CACHE_WORDS = 400_000
BLOCK_CHARS = 1_500_000
#: Texts whose ids show whether a tokenizer takes words one by one and in lower case.
PROBES = ["", " ", "The quick  brown\tfox\n", "Don't stop, it's 12.50 (or so)!", "NAÏVE Öl straße été “quoted” words—more", "x.y a-b c_d #tag @name 100% <tag> https://a.example/b?c=d", "Ωμέγα мир 世界 مرحبا", "I\u0307 e\u0301 🎉🎉 ab"]
#: Characters that end a word and are a pre-token of their own after letters (the apostrophe is not: it starts contractions).
MARKS = '.,;:!?*#$%&()[]{}<>|/-+=_~^@"'


class WordEncoder:
    """Token ids (little-endian unsigned 32-bit) of texts, by white-space separated parts that are encoded once.

    The tokenizer drops white space and never joins tokens across it, so a text's ids are those of its parts in order. Parts of
    letters only are one pre-token each, whose last token ends with `</w>`: they are encoded together and cut there. Letters and
    marks behind them are two.
    The cache holds at most CACHE_WORDS parts and starts anew beyond.

    A tokenizer of another kind, which its words' ends or the ids of PROBES show, encodes every text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.by_words = bool(self.ends.any()) and list(self._by_words(PROBES)) == list(self._whole(PROBES))
        self.known.clear()

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        for encoding in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(encoding.ids, "<u4").tobytes()

    def _encode_each(self, parts: list[str]) -> None:
        for part, encoding in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.known[part] = np.array(encoding.ids, "<u4").tobytes()

    def _encode_words(self, words: list[str], encoding) -> None:
        ids = np.array(encoding.ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            self._encode_each(words)
            return
        raw, at = ids.tobytes(), 0
        for word, cut in zip(words, (4 * cuts).tolist(), strict=True):
            self.known[word] = raw[at:cut]
            at = cut

    def _learn(self, parts: set[str]) -> None:
        words, others, composed = set(), [], []
        for part in parts:
            if part.isalpha():
                words.add(part)
            elif (core := part.rstrip(MARKS)).isalpha() and "İ" not in core:  # a dotted capital I leaves its dot to the marks
                composed.append((part, core, mark := part[len(core) :]))
                if core not in self.known:
                    words.add(core)
                if mark not in self.known:
                    others.append(mark)
            else:
                others.append(part)
        listed = list(words)
        lists = [listed[k : k + 500] for k in range(0, len(listed), 500)]
        for some, encoding in zip(lists, self.tokenizer.encode_batch_fast(list(map(" ".join, lists)), add_special_tokens=False), strict=True):
            self._encode_words(some, encoding)
        self._encode_each(list(dict.fromkeys(others)))
        for part, core, mark in composed:
            self.known[part] = self.known[core] + self.known[mark]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        return self._by_words(texts) if self.by_words else self._whole(texts)

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        split = [parts_of(text) for text in texts]
        missing = set().union(*split) - self.known.keys() if split else set()
        if len(missing) + len(self.known) > CACHE_WORDS:
            self.known.clear()
            missing = set().union(*split)
        self._learn(missing)
        get = self.known.__getitem__
        for parts in split:
            yield b"".join(map(get, parts))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")  # much faster than a look at each character
    except UnicodeEncodeError:
        return max(text) < "ɐ" and "İ" not in text
    return True


def parts_of(text: str) -> list[str]:
    """Parts between white space; lower-cased where that changes no id and saves repeated parts."""
    if "<|" not in text and (text.isascii() or _latin(text)):
        text = text.lower()
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to Python only
        return [p for p in text.translate(_SPACES).split(" ") if p]
    return text.split()


_SPACES = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}
#: One for each worker process.
_encoders: dict[str, WordEncoder] = {}


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), pc.dictionary_encode(batch.column(1).fill_null(""))
            distinct, rows, found = texts.dictionary, [], []  # equal texts of a batch are encoded once
            while len(found) < len(distinct):
                block, chars = [], 0
                while len(found) + len(block) < len(distinct) and (not block or chars < BLOCK_CHARS):
                    block.append(distinct[len(found) + len(block)].as_py())
                    chars += len(block[-1])
                for raw in encoder.encode(block):
                    raw += last
                    parts = [raw[at : at + 4 * capacity] for at in range(0, len(raw), 4 * capacity)]
                    found.append([(piece, piece * capacity, len(part) // 4, zlib.crc32(part)) for piece, part in enumerate(parts)])
            for doc_id, k in zip(ids, texts.indices.to_pylist(), strict=True):
                rows += [(doc_id, *piece) for piece in found[k]]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        # the worker may do another step next; a task fills the cache more than once anyway
        encoder.known.clear()
        give_back()

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length, in the order given.

    counts[g] is the number of open bins with residual gap g. A piece goes into the open bin it fits in for which the sum of
    counts[g] ** 2 becomes smallest (ties: the smaller gap), and into a new bin only if it fits in none. Full bins don't count.
    """
    counts = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(lengths), np.int64)
    n_bins, far = 0, np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        before, after = counts[s:], counts[: capacity - s + 1]  # of gaps g, and of the gaps g - s that would be left
        change = np.where(before > 0, 2 * (after - before + 1), far)
        if before[0] > 0:
            change[0] = 1 - 2 * before[0]  # it fills the bin
        g = int(np.argmin(change)) + s
        if counts[g] > 0:
            b = waiting[g].pop()
            counts[g] -= 1
        else:
            b, g = n_bins, capacity
            n_bins += 1
        out[i] = b
        if g > s:
            counts[g - s] += 1
            waiting[g - s].append(b)
    return out


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd  # takes 20 MB, which workers that tokenise do without

        group = group.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        bins = sum_of_squares(group.length.to_numpy(), capacity)
        fill = np.bincount(bins, weights=group.length.to_numpy()).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        group = group.iloc[order].copy()
        bins, lengths = bins[order], group.length.to_numpy()
        ends = np.cumsum(lengths)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        offset = ends - lengths - np.maximum.accumulate(np.where(first, ends - lengths, 0))
        return pd.DataFrame({"uid": group.uid, "length": lengths, "chunk": group.chunk, "bin": bins, "offset": offset, "filled": fill[bins]})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, chunk_pieces: int = CHUNK_PIECES, least_fill: float = 0.98) -> DataFrame:
    """`pieces` (any columns, with `length` long from 1 to capacity) with sequence_id and offset.

    Pieces are dealt evenly to chunks by hash; each chunk packs its own by sum of squares, longest first. Bins filled less
    than `least_fill` are opened again and packed together once more, until one chunk holds them all, or a level closes so few that
    another would gain little: its bins stay as they are. So no chunk ever gets more than about `chunk_pieces`.
    """
    pieces = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces", BATCH_BYTES)
    rest, done, level = pieces.select("uid", "length"), [], 0
    n = pieces.count()
    while True:
        chunks = max(1, -(-n // chunk_pieces))
        dealt = rest.withColumn("chunk", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(chunks)).cast("int"))
        packed = dealt.groupBy("chunk").applyInPandas(_pack(capacity), "uid long, length long, chunk int, bin long, offset long, filled long")
        packed = stored(packed, "packed")
        number = ((F.lit(level).cast("long") * (1 << 56)) + F.col("chunk").cast("long") * (1 << 32) + F.col("bin")).alias("sequence_id")
        if chunks == 1:
            done.append(packed.select("uid", number, "offset"))
            break
        open_again = F.col("filled") < int(capacity * least_fill)
        rest = packed.where(open_again).select("uid", "length")
        left = rest.count()
        if left > chunk_pieces and left > MOST_LEFT * n:
            done.append(packed.select("uid", number, "offset"))
            break
        done.append(packed.where(~open_again).select("uid", number, "offset"))
        if left == 0:
            break
        n, level = left, level + 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.union(more)
    return pieces.join(placed, "uid").drop("uid")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then `end_id`; only those longer than `capacity` are cut, into pieces of `capacity` and a shorter
    last one. Null and empty texts are one piece of one id. Repeated rows are packed each; ids may be null. Other columns
    of any name are ignored; an empty table gives no rows. The tokenizer file must be at the same path on all machines.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return pack(docs.mapInArrow(_pieces(tokenizer_path, end_id, capacity), schema), capacity, **options)
