"""What a Python worker holds."""

import subprocess
import sys

import numpy as np
import pyarrow as pa

from catalograin.llm import langid


def _words(n, seed=1):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäéñжя"))
    return sorted({"".join(rng.choice(letters, k)) for k in rng.integers(1, 12, n)})


def _counts(words):
    rows = {}
    for i, word in enumerate(words):
        lang = ("en", "de")[i % 2]
        rows[lang, "s", langid.script_of(word)] = rows.get((lang, "s", langid.script_of(word)), 0) + len(word)
        for gram in langid.grams_of(word):
            rows[lang, "g", gram] = rows.get((lang, "g", gram), 0) + 1
    columns = list(zip(*rows, strict=True))
    return pa.table({"lang": columns[0], "kind": columns[1], "item": columns[2], "n": list(rows.values())})


def _held(*objects):
    """Bytes of all that is reachable."""
    seen, total, todo = set(), 0, list(objects)
    while todo:
        x = todo.pop()
        if id(x) in seen:
            continue
        seen.add(id(x))
        if isinstance(x, np.ndarray | pa.Array):
            total += x.nbytes
        else:
            total += sys.getsizeof(x)
            todo += [*x.keys(), *x.values()] if isinstance(x, dict) else vars(x).values() if hasattr(x, "__dict__") else x if isinstance(x, list | tuple) else []
    return total


def test_grams_are_held_in_arrays_and_found_exactly():
    words = _words(20_000)
    table = _counts(words)
    model = langid.Model(table, ["en", "de"])
    grams = {g for k, g in zip(table["kind"].to_pylist(), table["item"].to_pylist(), strict=True) if k == "g"}
    assert len(model.gram) == len(grams) and all(g in model.gram for g in list(grams)[:300])
    assert _held(model) < 60 * len(grams)  # a dict of texts takes over 130 each

    asked = [*words[:500], "x", "жя", "𝒳𝒳", "neverseen", "straße" * 40]
    trigrams, size, whole = model.gram.find(asked)
    place = {}
    for gram, k in zip((g for w in asked for g in langid.grams_of(w)[:-1]), trigrams.tolist(), strict=True):
        assert (k >= 0) == (gram in grams) and place.setdefault(gram, k) == k
    for word, k in zip(asked, whole.tolist(), strict=True):
        assert (k >= 0) == (f"<{word}>" in grams) and place.setdefault(f"<{word}>", k) == k
    found = [k for k in place.values() if k >= 0]
    assert len(found) == len(set(found)) and size.tolist() == list(map(len, asked))


def test_grams_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(langid, "_hashes", lambda grams: np.array([len(g) % 2 for g in grams.to_pylist()], np.uint64))
    names = [f"<{w}>" for w in _words(200)]
    grams = langid.Grams(pa.array([*names, "<qw"]))
    assert len(grams) == len(names) + 1 and all(n in grams for n in names) and "<notthere>" not in grams
    _, _, whole = grams.find([n[1:-1] for n in names])
    assert sorted(whole.tolist()) == sorted(set(whole.tolist())) and (whole >= 0).all()


def test_a_text_is_taken_apart_alone(monkeypatch):
    """The words of a block's texts are never held together."""
    model, held = langid.Model(_counts(_words(300)), ["en", "de"]), []

    class Found(list):
        def __init__(self, words):
            super().__init__(words)
            held.append(1)
            most.append(sum(held))

        def __del__(self):
            held.pop()

    most, before = [], langid.words_of
    monkeypatch.setattr(langid, "words_of", lambda text: Found(before(text)))
    langid.Labeller(model, 2.0).label(["one two three", "four five", "six"] * 20)
    assert max(most) <= 2


def test_tokenising_needs_no_pandas():
    code = "import sys; import catalograin.llm.packing, catalograin.llm.langid; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
