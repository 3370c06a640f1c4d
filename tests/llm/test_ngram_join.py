import pyarrow as pa
import pytest

from catalograin.llm.components import components
from catalograin.llm.ngram_join import keep_one, ngram_join, shingle_sets


def brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 2_000_000), (5, 80, 2_000_000), (4, 85, 200)])
def test_against_brute_force(spark, near_docs, width, percent, block):
    """The small blocks make components span several tasks."""
    got = ngram_join(spark.createDataFrame(near_docs, "doc_id long, text string"), width, percent, block_shingles=block).collect()
    want = brute(near_docs, width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert any(i != c for i, (_, c) in want.items())


def test_edges(edge_docs, no_docs):
    rows = ngram_join(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[1]["n_shingles"], by_id[1]["component_id"]) == (0, 1)
    assert by_id[4]["component_id"] == 4 and by_id[None]["component_id"] == 4
    assert by_id[5]["n_shingles"] == 5000
    assert ngram_join(no_docs).count() == 0


def test_one_of_each_group_stays(spark, near_docs):
    docs = spark.createDataFrame([*near_docs, near_docs[0]], "doc_id long, text string")
    want = {c for _, c in brute(near_docs, 4, 85).values()}
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == sorted(want)


def test_rows_of_one_id_are_told_apart(spark):
    """Nothing links rows but their texts: neither a null id nor a repeated one."""
    own = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcdef"]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (7, own[2]), (7, own[3]), (8, own[3]), (9, own[4]), (None, own[4]), (7, own[5]), (7, ""), (7, None)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, own[0]), (None, own[1]), (7, own[2]), (7, own[3]), (7, own[5]), (9, own[4])]
    assert sorted(map(str, (tuple(r) for r in got if r["text"]))) == sorted(map(str, want))
    assert {r["text"] for r in got if not r["text"]} == {"", None}


def test_shingles_are_of_whole_words():
    sets = dict(shingle_sets(pa.array(["A b  c\td e", "a B c d", None, "ab c d", "x"]), 4))
    assert [len(sets[i]) for i in range(5)] == [2, 1, 0, 1, 1]
    assert set(sets[1]) < set(sets[0]) and not set(sets[3]) & set(sets[0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
