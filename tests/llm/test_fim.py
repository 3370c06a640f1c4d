import hashlib
import re

import pytest

from catalograin.llm import fim


def brute(doc_id, text, grammar_units):
    text = text or ""
    u = grammar_units(text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, None, text
    p, m, s = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    spm = h[3] % 100 < 20
    return len(u), "spm" if spm else "psm", p, m, s, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


UNITS = {
    fim.CODE_POINTS: list,
    fim.WORDS: lambda t: re.findall(r"[ \t-\r]+|[^ \t-\r]+", t),
    fim.SPACED_WORDS: lambda t: re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z", t),
    fim.LINES: lambda t: t.splitlines(keepends=True) if "\r" not in t else re.findall(r"[^\n]*\n|[^\n]+", t),
}
TEXTS = ["", None, "a", "ab", "\n", " \n\n x\r\ny ", "wörd 𝒳𝒴 é🎉🎉 Ω\n𝒵", "<P", "a<", "<S", "S>P>", "<P>x", "y<M>", "<M", "one two  three\tfour\nfive ", "퟿\x00z", "éé ‍🏳️‍🌈"]


@pytest.mark.parametrize("grammar", list(UNITS))
def test_against_brute_force(spark, grammar):
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS for _ in range(20))] + [(None, "no id"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.fill_in_middle(docs, grammar).collect()
    want = [(i, *brute(i, t, UNITS[grammar])) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_digests_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS for _ in range(20))]
    for r in fim.digests(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        text = rows[r["doc_id"]][1] or ""
        n, form, p, m, _, output = brute(r["doc_id"], text, list)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, None if p is None else len(p), None if m is None else len(m))
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_edges(edge_docs, no_docs):
    rows = fim.digests(fim.fill_in_middle(edge_docs)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in edge_docs.select("doc_id", "text").collect()}
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert r["n"] == len(texts[r["doc_id"]]) and r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert fim.digests(fim.fill_in_middle(no_docs)).count() == 0
