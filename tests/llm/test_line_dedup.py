from catalograin.llm.line_dedup import dedup_lines


def result(df):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()}


def test_recurring_lines_stay_once(spark):
    docs = spark.createDataFrame([(1, "Subscribe to our news letter\nalpha beta gamma delta one"), (2, "own words of the second text\nSubscribe to our news letter"), (3, "Subscribe  to our news letter")], "doc_id long, text string")
    got = result(dedup_lines(docs))
    assert got[1] == ("Subscribe to our news letter\nalpha beta gamma delta one", 2, 0)
    assert got[2] == ("own words of the second text", 2, 1)
    assert got[3] == ("", 1, 1)


def test_variable_fields_make_a_template(spark):
    rows = [(i, f"Page viewed by user{i} at {i}:30 from the start\nsome {chr(97 + i)} text") for i in range(4)]
    rows += [(i, f"Written by our editor {name} in the city office today") for i, name in ((10, "Ann"), (11, "Bob"), (12, "Eve"))]
    got = result(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i][2] for i in range(4)] == [0, 1, 1, 1]
    assert [got[i][2] for i in (10, 11, 12)] == [0, 1, 1]


def test_several_templates_in_a_leaf(spark):
    """Two equally common templates with one beginning, one that shares their end, and much unrelated prose of the same length and beginning."""
    names = ["Ann", "Bob", "Eve", "Max"]
    rows = [(k, f"Written by our editor {n} in the city office") for k, n in enumerate(names)]
    rows += [(10 + k, f"Written by our reporter {n} from a farm house") for k, n in enumerate(names)]
    rows += [(20 + k, f"Written by our guest {n} at the city office") for k, n in enumerate(names)]
    rows += [(100 + k, "Written by our " + " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + p)}" for p in range(6))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(dedup_lines(docs))
    for first in (0, 10, 20):
        assert [got[first + k][2] for k in range(4)] == [0, 1, 1, 1]
    assert sum(got[100 + k][2] for k in range(200)) == 0


def test_one_document_and_short_lines_are_left(spark):
    docs = spark.createDataFrame([(1, "a b c d e\na b c d e"), (2, "the end\nx"), (3, "the end\ny")], "doc_id long, text string")
    assert all(n == 0 for _, _, n in result(dedup_lines(docs)).values())


def test_least_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sum(n for _, _, n in result(dedup_lines(docs, min_docs=3)).values()) == 0


def test_edges(edge_docs, no_docs):
    out = dedup_lines(edge_docs)
    assert out.columns == [*edge_docs.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["text"] is None and by_id[1]["n_lines"] == 0
    assert by_id[2]["text"] == "" and by_id[5]["n_dropped"] == 0
    assert dedup_lines(no_docs).count() == 0


def test_many_variable_fields(spark):
    """Three of eight tokens vary; also among other lines of the same length and beginning."""
    fields = [("Ann", "cats", "kids"), ("Bob", "dogs", "teens"), ("Eve", "birds", "adults"), ("Max", "frogs", "elders"), ("Kim", "cows", "babies"), ("Joe", "bees", "nurses")]
    rows = [(k, f"report written by {a} about {b} for {c}") for k, (a, b, c) in enumerate(fields)]
    got = result(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k][2] for k in range(6)] == [0, 1, 1, 1, 1, 1]
    rows += [(100 + k, "report written by " + " ".join(f"w{chr(97 + k)}{chr(97 + p)}" for p in range(5))) for k in range(26)]
    got = result(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k][2] for k in range(6)] == [0, 1, 1, 1, 1, 1] and sum(got[100 + k][2] for k in range(26)) == 0


def test_like_beginnings_are_no_template(spark):
    rows = [(k, f"we went to {a} {b}") for k, (a, b) in enumerate((("see", "them"), ("eat", "cake"), ("buy", "bread")))]
    assert sum(n for _, _, n in result(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))).values()) == 0


def test_short_lines_and_scripts_without_spaces(spark):
    boiler = "本网站的所有内容均受版权保护未经许可不得转载或者使用任何内容"
    rows = [(k, f"All rights reserved.\n{boiler}\n7 12 9 55 80 3\nown text number {chr(97 + k)}") for k in range(20)]
    got = result(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k][2] for k in range(20)] == [0] + [2] * 19
    assert got[1][0] == "7 12 9 55 80 3\nown text number b"
    got = result(dedup_lines(spark.createDataFrame(rows[:19], "doc_id long, text string")))
    assert [got[k][2] for k in range(19)] == [0] + [1] * 18


def test_long_text_is_rebuilt_in_one_pass(spark):
    lines = [f"line of a long text with word{i} here {'x' * (i % 7)}".replace("word", chr(97 + i % 26)) for i in range(32_000)]
    unique = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} stands alone in its very own line {'y' * (i % 5)}" for i in range(0, 32_000, 2)]
    docs = spark.createDataFrame([(1, "\n".join(lines + unique)), (2, "\n".join(lines[:20]))], "doc_id long, text string")
    got = result(dedup_lines(docs))
    assert got[2][2] == 20 and got[1][1] == 48_000


def test_hot_and_shuffled_lines_agree(spark, monkeypatch):
    from catalograin.llm import storage

    rows = [(k, f"the same line in every document\nsome pair {chr(97 + k // 2)} of lines\nown {chr(97 + k)}") for k in range(26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = result(dedup_lines(docs))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    assert result(dedup_lines(docs)) == expected
    assert [expected[k][2] for k in range(4)] == [0, 2, 1, 2]


def test_own_columns_stay(spark):
    from catalograin.llm.line_dedup import drop_lines

    docs = spark.createDataFrame([(1, "a line of five words", 7, "x"), (2, "a line of five words", 8, "y")], "doc_id long, text string, n_lines long, gone string")
    assert sorted(map(tuple, drop_lines(docs).collect())) == [(1, "a line of five words", 7, "x"), (2, "", 8, "y")]


def test_very_long_lines(spark):
    """Three lines of 20,000 words agree in their first seven tenths, in a leaf crowded with others: each of their thousands of common stretches has the same lines."""
    n = 20_000
    word = lambda k, i: f"{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"
    head = ["all", "begin", "so"]
    common = head + [word(0, i) for i in range(3, n * 7 // 10)]
    lines = [" ".join(common + [word(1 + k, i) for i in range(len(common), n)]) for k in range(3)]
    lines += [" ".join(head + [word(5 + k, i) for i in range(3, n)]) for k in range(9)]
    got = result(dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")))
    assert [got[i][2] for i in range(12)] == [0, 1, 1] + [0] * 9


def test_majority_of_many_lines(spark, monkeypatch):
    """Weighted, over several rounds of two lines each, as counted by hand; with a row for each line, not for each of its tokens."""
    import random
    from collections import Counter

    from catalograin.llm import line_dedup

    rng, rows, want = random.Random(3), [], {}
    for leaf in range(60):
        lines = [(rng.choice([1, 1, 2, 5]), [rng.choice("aaab") if k % 2 else rng.choice("abcdef") for k in range(6)]) for _ in range(rng.choice([3, 4, 7, 40]))]
        rows += [(leaf, len(lines), i, leaf, n, tokens) for i, (n, tokens) in enumerate(lines)]
        counts = [Counter() for _ in range(6)]
        for n, tokens in lines:
            for count, token in zip(counts, tokens, strict=True):
                count[token] += n
        want[leaf] = [t if 2 * n > sum(c.values()) else "<*>" for c in counts for t, n in c.most_common(1)]
    lines = spark.createDataFrame(rows, "leaf long, lines long, h1 long, h2 long, n long, tokens array<string>")
    for most in (64, 2):
        monkeypatch.setattr(line_dedup, "MOST_MET", most)
        found = line_dedup._majority(lines, "leaf")
        assert {r["leaf"]: r["template"] for r in found.collect()} == want
        assert "Generate" not in found._jdf.queryExecution().toString()
