"""Token counts: unigram segmentation of distinct pre-tokens, sharing forward scores along a trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 200_000
#: Nodes of a task's trie, of about 200 bytes.
MAX_NODES = 500_000
BLOCK_CHARS = 1_500_000
SPACE = "▁"
#: Score of a code point that no piece covers, which counts as `n` byte tokens; below that of any piece.
UNKNOWN_SCORE = -30.0


def unigram_pieces(model_path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with log-probabilities by a Zipf-Mandelbrot law of their rank (tokenizers are not trained)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranks = np.arange(len(kept)) + 2.7
    scores = -np.log(ranks) - np.log(np.sum(1 / ranks))
    return {model.id_to_piece(i): float(s) for i, s in zip(kept, scores, strict=True)}


class PreTokenTrie:
    """Best unigram segmentations of pre-tokens, as counts.

    A node stands for a prefix and holds the best score of its segmentations and their least number of tokens among equals, computed once
    for all pre-tokens below, of whatever text. Terminal counts are kept for at most CACHE_WORDS pre-tokens, and the trie starts
    anew beyond MAX_NODES nodes, so that a task's memory is bounded.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.counts: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.below: dict[int, int] = {}  # a node's number and a code point, to the node below
        self.best, self.count = [0.0], [0]

    @property
    def nodes(self) -> int:
        return len(self.best) - 1

    def insert(self, words: list[str]) -> None:
        """Store the terminal counts of pre-tokens."""
        pieces, longest, get = self.pieces, self.longest, self.pieces.get
        path, at, best, count = "", [0], [0.0], [0]  # of the pre-token before: in sorted order most of the way down is the same
        for word in sorted(words):
            if len(self.best) > MAX_NODES:
                self._reset()
                path, at, best, count = "", [0], [0.0], [0]
            below, bests, counts = self.below, self.best, self.count
            marked = SPACE + word
            shared, most = 0, min(len(path), len(marked))
            while shared < most and path[shared] == marked[shared]:
                shared += 1
            del at[shared + 1 :], best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                code = ord(marked[end - 1])
                key = at[-1] << 21 | code
                node = below.get(key)
                if node is None:
                    top = best[end - 1] + UNKNOWN_SCORE
                    n = count[end - 1] + (1 if code < 0x80 else 2 if code < 0x800 else 3 if code < 0x10000 else 4)
                    for begin in range(max(0, end - longest), end):
                        score = get(marked[begin:end])
                        if score is not None:
                            score += best[begin]
                            if score > top or (score == top and count[begin] + 1 < n):
                                top, n = score, count[begin] + 1
                    node = below[key] = len(bests)
                    bests.append(top)
                    counts.append(n)
                at.append(node)
                best.append(bests[node])
                count.append(counts[node])
            path = marked
            self.counts[word] = count[-1]

    def totals(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        split = [text.split() for text in texts]
        missing = set().union(*split) - self.counts.keys() if split else set()
        if len(missing) + len(self.counts) > CACHE_WORDS:
            self.counts.clear()
            missing = set().union(*split)
        self.insert(list(missing))
        get = self.counts.__getitem__
        for words in split:
            yield len(words), sum(map(get, words))


def _count(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PreTokenTrie(pieces.value)
        for batch in batches:
            texts, words, tokens = batch.column(1), [], []
            while len(words) < len(texts):
                block, chars = [], 0
                while len(words) + len(block) < len(texts) and (not block or chars < BLOCK_CHARS):
                    block.append(texts[len(words) + len(block)].as_py() or "")
                    chars += len(block[-1])
                for n_words, n_tokens in trie.totals(block):
                    words.append(n_words)
                    tokens.append(n_tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words (pre-tokens between white space) and n_tokens of the best unigram segmentation of each.

    A pre-token starts with the space mark. Equal scores go to fewer tokens; a code point of no piece counts as its UTF-8 bytes.
    Null, empty and blank texts have 0 of both. Repeated rows and null ids stay; other columns of any name are ignored; an empty
    table gives no rows.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_count(broadcast), f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
