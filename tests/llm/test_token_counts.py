import random

import public_tokenizers

from catalograin.llm.token_counts import SPACE, UNKNOWN_SCORE, PreTokenTrie, count_tokens, unigram_pieces


def viterbi(pieces, word):
    """Best (score, -tokens) by trying all segmentations of each prefix."""
    text = SPACE + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[end - 1][0] + UNKNOWN_SCORE, best[end - 1][1] - len(text[end - 1].encode()))]
        options += [(best[b][0] + pieces[text[b:end]], best[b][1] - 1) for b in range(end) if text[b:end] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_against_plain_viterbi():
    rng = random.Random(2)
    pieces = {"".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3]))): -float(rng.choice([1, 2, 3, 4])) for _ in range(25)} | {SPACE: -1.0, SPACE + "a": -1.5}
    words = sorted({"".join(rng.choice("abéz𝒳") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    trie = PreTokenTrie(pieces)
    trie.insert(rng.sample(words, len(words)))
    assert trie.counts == {w: viterbi(pieces, w) for w in words}
    assert trie.nodes < sum(len(w) + 1 for w in words)


def test_shared_prefixes_are_computed_once():
    trie = PreTokenTrie({c: -1.0 for c in "abc" + SPACE})
    trie.insert(["abca", "abcb", "abc", "ab"])
    assert trie.nodes == len(SPACE + "abc") + 2


def test_the_trie_lasts_beyond_a_block(monkeypatch):
    pieces = {c: -1.0 for c in "abcde" + SPACE} | {"ab": -1.2, "cd": -1.1}
    trie = PreTokenTrie(pieces)
    list(trie.totals(["abcd"]))
    before = trie.nodes
    assert [list(trie.totals([t])) for t in ("abce", "abcd abc")] == [[(1, viterbi(pieces, "abce"))], [(2, viterbi(pieces, "abcd") + viterbi(pieces, "abc"))]]
    assert trie.nodes == before + 1
    monkeypatch.setattr("catalograin.llm.token_counts.MAX_NODES", 3)
    small = PreTokenTrie(pieces)
    assert list(small.totals(["abcd abce dab", "cab abcd"])) == [(3, sum(viterbi(pieces, w) for w in ("abcd", "abce", "dab"))), (2, sum(viterbi(pieces, w) for w in ("cab", "abcd")))]


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("catalograin.llm.token_counts.CACHE_WORDS", 3)
    trie = PreTokenTrie({c: -1.0 for c in "abcdef" + SPACE})
    assert [list(trie.totals([t])) for t in ("a b c", "d e f", "a d")] == [[(3, 6)], [(3, 6)], [(2, 4)]]


def test_edges(edge_docs, no_docs):
    pieces = unigram_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(pieces) > 30_000 and abs(sum(2.718281828 ** s for s in pieces.values()) - 1) < 1e-6
    rows = count_tokens(edge_docs, pieces).collect()
    by_id = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in rows}
    assert len(rows) == edge_docs.count()
    assert by_id[1] == by_id[2] == by_id[3] == (0, 0) and by_id[4] == by_id[None] == (3, sum(viterbi(pieces, w) for w in ("one", "two", "three")))
    assert by_id[5][0] == 30_000
    assert count_tokens(no_docs, pieces).count() == 0
