import hashlib
import random
import re
from collections import Counter

import pytest

from catalograin.llm.decontaminate import PositionalIndex, decontaminate, drop_contaminated

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, width):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            windows = [b[i : i + width] for i in range(max(len(b) - width, 0) + 1)] if b else []
            for window in windows:
                for s in range(len(w) - len(window) + 1):
                    if w[s : s + len(window)] == window:
                        hit.update(range(s, s + len(window)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def brute_near(docs, items, width, within):
    """Items near in each text: all words of a window around a place of the one that is rarest in all texts."""
    counts = Counter(w for _, text in docs for w in words(text))
    out = {}
    for doc_id, text in docs:
        w, found = words(text), set()
        for item, t in items:
            b = words(t)
            for window in [b[i : i + width] for i in range(max(len(b) - width, 0) + 1)] if b else []:
                rarest = min(window, key=lambda x: (counts[x], window.index(x)))
                if any(w[p] == rarest and set(window) <= set(w[max(p - within, 0) : p + within + 1]) for p in range(len(w))):
                    found.add(item)
        out[doc_id] = len(found)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "Élan", "x9", "foo", "BAR", "q", "zz", "über"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40])))) for i in range(60)]
    items = [(i, ", ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8])))) for i in range(12)]
    docs += [(100, "say " + items[0][1].upper() + " end"), (101, None)]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 4)
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=4, within=3)
    assert {r["doc_id"]: r["n_near"] for r in got.collect()} == brute_near(docs, items, 4, 3)


def test_shuffled_tables_agree_with_broadcast_ones(spark, monkeypatch):
    from catalograin.llm import storage

    docs = spark.createDataFrame([(i, f"some text of number w{i % 3} and words here") for i in range(12)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "number w1 and"), (2, "here words"), (3, "absent")], "item_id long, text string")
    expected = sorted(map(tuple, decontaminate(docs, items, within=15).collect()))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontaminate(docs, items, within=15).collect())) == expected
    assert [r[-1] for r in expected] == [2 if i % 3 == 1 else 1 for i in range(12)]


def test_near(spark):
    docs = spark.createDataFrame([(1, "red apple on a big tree"), (2, "tree with a single very green apple"), (3, "apple")], "doc_id long, text string")
    index = PositionalIndex(docs, spark.createDataFrame([("apple",), ("tree",)], "word string"))
    phrases = spark.createDataFrame([(0, ["apple", "tree"])], "phrase long, words array<string>")
    near = lambda k: {r["id"] for r in index.near(phrases, k).join(index.rows, "uid").collect()}
    assert near(4) == {1} and near(6) == {1, 2}
    with pytest.raises(ValueError):
        near(0)


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "one two"), (3, "three"), (3, "three")], "item_id long, text string")
    rows = decontaminate(edge_docs, items).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_words"] == 0 and not by_id[1]["contaminated"]
    assert by_id[4]["n_hit"] == 3 and by_id[4]["n_items"] == 1 and by_id[None]["n_hit"] == 3
    assert decontaminate(no_docs, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(edge_docs, items.limit(0)).collect())
    assert {r["doc_id"] for r in drop_contaminated(edge_docs, items).collect()} == {1, 2, 3, 5, 6, 7}


def test_clean_rows_of_a_contaminated_id_stay(spark):
    docs = spark.createDataFrame([(None, "say one two three"), (None, "clean"), (None, None), (4, "one two three"), (4, "also clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = drop_contaminated(docs, items).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(None, "clean"), (None, None), (4, "also clean")]))
