import random
import re

import numpy as np
import pyarrow as pa

from catalograin.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places, covered = {}, set()
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    for starts in places.values():
        if len(starts) > 1:
            for s in starts:
                covered.update(range(s, s + 8))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)]


def test_statistics_against_brute_force():
    rng = random.Random(4)
    pieces = ["a", "bb", "é#", "𝒳", "|", "x|y", "\n", "\n", " ", "\t", "\x0b", "the end\n", "w1 w2 w3 w4 w5 w6 w7 w8 ", "&<>"]
    texts = [None, "", "\n", "\n\n", " ", "a", *("".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.choice([3, 30, 300]))) for _ in range(120))]
    assert quality.statistics(pa.array(texts))[:, :5].tolist() == [brute(t) for t in texts]


def test_blocks_do_not_matter(monkeypatch):
    from catalograin.llm import wordbytes

    texts = pa.array(["some text here " * k + "\nline\nline" for k in range(40)])
    want = quality.statistics(texts)
    monkeypatch.setattr(wordbytes, "BLOCK_BYTES", 100)
    assert (quality.statistics(texts) == want).all()


def test_path_lengths():
    """Rows far from all others have short paths; the box makes values isolated that no row of the sample has."""
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 2)), np.zeros((500, 1))], 1)
    forest = quality.IsolationForest(rows, np.array([-9.0, -9, 0]), np.array([9.0, 9, 9]))
    scores = forest.score(np.array([[0.0, 0, 0], [8, 8, 0], [0, 0, 8]]))
    assert scores[0] < 0.5 < scores[1] and scores[2] > scores[0] + 0.1


def rows_and_labels(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + rng.choice(["", "", "ly."]) + str(i)[:0] + rng.choice("abcdefg") for _ in range(60))) for i in range(300)]
    bad = [(1000 + i, " ".join(rng.choice(["###", "$$$x", "a|b", "%%", "qq"]) + rng.choice("abcdefg") for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1 if i < 1000 else 0, 0) for i, _ in good[::2] + bad[::2]], "doc_id long, quality long, toxic long")


def test_held_out_rows(spark):
    docs, labels = rows_and_labels(spark)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert np.mean([k for i, k in kept.items() if i < 1000]) > 0.97
    assert np.mean([k for i, k in kept.items() if i >= 1000]) < 0.05


def test_edges(spark, edge_docs, no_docs):
    docs, labels = rows_and_labels(spark)
    for rules in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0)), quality.fit(no_docs, labels)):
        rows = quality.judge(edge_docs, rules).collect()
        by_id = {r["doc_id"]: r for r in rows}
        assert len(rows) == edge_docs.count() and by_id[1]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
        assert by_id[5]["n_words"] == 30_000 and by_id[5]["n_repeat_words"] == 30_000
        assert quality.judge(no_docs, rules).count() == 0


def test_ranges_and_threshold_come_from_all_labels(spark, monkeypatch):
    """One labelled row in thousands widens a range, and few trees' rows leave the threshold as all labelled rows say."""
    docs, labels = rows_and_labels(spark)
    monkeypatch.setattr(quality, "TREES", 4)
    monkeypatch.setattr(quality, "TREE_ROWS", 8)
    seen = {}
    make, threshold_of = quality.IsolationForest.__init__, quality.threshold_of
    monkeypatch.setattr(quality.IsolationForest, "__init__", lambda self, rows, low, high, *size: seen.update(rows=len(rows), low=low, high=high) or make(self, rows, low, high, *size))
    monkeypatch.setattr(quality, "threshold_of", lambda cuts, good, bad, loss: seen.update(n=int(good.sum() + bad.sum())) or threshold_of(cuts, good, bad, loss))
    quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stats = quality.statistics(pa.array([texts[r["doc_id"]] for r in labels.collect()]))
    rows = quality.features(stats)[~quality.base_failed(stats)]
    assert seen["n"] == len(rows) > 4 * seen["rows"] / 2 and np.allclose(seen["low"], rows.min(0)) and np.allclose(seen["high"], rows.max(0))


def test_threshold():
    cuts, good, bad = np.array([0.1, 0.2, 0.3, 0.4]), np.array([900, 98, 2, 0]), np.array([0, 1, 3, 6])
    assert quality.threshold_of(cuts, good, bad, 0.0025) == 0.25 and np.isclose(quality.threshold_of(cuts, good, bad, 0.001), 0.35)
    assert quality.threshold_of(cuts, good, good, 1.0) == np.inf
