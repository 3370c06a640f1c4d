import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from catalograin.llm.packing import WordEncoder, pack, pack_documents, sum_of_squares

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_is_the_tokenizer():
    plain = Tokenizer.from_file(PATH)
    texts = ["", " ", "Hello, World!", "it's we'll don't", "STRAßE ΣΑΣ İstanbul ǅ", "á éx ́", "x\x1cy\x1f z\x85w v　u", "<|endoftext|> <|ENDOFTEXT|>", "…... a.b. #$% 12345 日本語 текст 🙂🙂", "naïve—word... (x) fin.", "a\r\nb\x0bc\x0cd", "İ. xİ!? ẞ. ſ,"]
    got = [np.frombuffer(b, "<u4").tolist() for b in WordEncoder(PATH).encode(texts * 2)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts * 2]


def test_sum_of_squares_is_best():
    """Each piece goes where the sum of squares becomes smallest, by trying all places."""
    rng, capacity = np.random.default_rng(1), 20
    lengths = rng.integers(1, capacity + 1, 200)
    bins = sum_of_squares(lengths, capacity)
    gaps, fill = {}, {}
    for n, b in zip(lengths.tolist(), bins.tolist(), strict=True):
        def value(gap, gaps=gaps, n=n):
            after = dict(gaps)
            if gap < capacity:
                after[gap] -= 1
            if gap > n:
                after[gap - n] = after.get(gap - n, 0) + 1
            return sum(v * v for v in after.values())

        places = [g for g, k in gaps.items() if k > 0 and g >= n] or [capacity]
        gap = capacity - fill.get(b, 0)
        assert value(gap) == min(map(value, places))
        if gap < capacity:
            gaps[gap] -= 1
        if gap > n:
            gaps[gap - n] = gaps.get(gap - n, 0) + 1
        fill[b] = fill.get(b, 0) + n
    assert max(fill.values()) <= capacity


def check(rows, capacity):
    for sequence in {r["sequence_id"] for r in rows}:
        own = sorted((r for r in rows if r["sequence_id"] == sequence), key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


@pytest.mark.parametrize("chunk", [50_000, 40])
def test_pack(spark, chunk):
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.integers(1, 101, 600)]
    rows = pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), 100, chunk).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(600))
    check(rows, 100)
    assert len({r["sequence_id"] for r in rows}) <= (1.03 if chunk > 600 else 1.06) * sum(lengths) / 100 + 3


def test_no_chunk_gets_everything(spark):
    """Pieces of which no two fit together stay open at each level; beside them, small ones fill some bins."""
    lengths = [60] * 1500 + [40] * 200
    rows = pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), 100, 100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1700))
    check(rows, 100)
    assert len({r["sequence_id"] for r in rows}) <= 1.03 * 1500
    chunks = Counter(r["sequence_id"] >> 32 for r in rows)  # level and chunk
    assert max(chunks.values()) <= 150


def test_documents(spark, edge_docs, no_docs):
    rows = pack_documents(edge_docs, PATH).collect()
    check(rows, 4096)
    plain = Tokenizer.from_file(PATH)
    want = []
    for d in edge_docs.collect():
        ids = np.array([*plain.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d["doc_id"], k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows)
    assert pack_documents(no_docs, PATH).count() == 0


def test_other_tokenizers_encode_whole_texts():
    """A tokenizer that keeps case and white space isn't taken by words."""
    from tokenizers import Tokenizer

    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        encoder, plain = WordEncoder(path), Tokenizer.from_file(path)
        texts = ["Some  Words\n of a text, with MARKS (and so on).", "", "été 𝒳 12.5%  ", "a b"]
        assert encoder.by_words == by_words
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
