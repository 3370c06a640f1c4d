import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = "the of and a to in is that it for was on as with be by this are an".split() + [f"w{i}x" for i in range(500)]
    own = lambda n: " ".join(rng.choice(words).replace("0", "o").replace("1", "l") for _ in range(n))
    base = own(80)
    leak = "one benchmark passage of more than ten words that must not stay in training data"
    rows = [(i, own(60), "en") for i in range(30)] + [(100, base, "en"), (101, base + "\nmore of it", "en"), (102, own(20) + " " + leak + " " + own(20), "en"), (103, "12 34 --", "en"), (104, None, "en")]
    rows += [(200 + i, f"Read also our other fine pages today\n{own(40)}", "en") for i in range(5)]
    sf_dir = str(tmp_path)
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids, columns = {}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/{k}")
        docs = spark.read.parquet(f"{sf_dir}/{k}")
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "line_dedup":
            assert sum("Read also" in r["text"] for r in docs.collect()) == 1
    assert ids["language_id"] == {r[0] for r in rows} - {103, 104}
    assert ids["line_dedup"] == ids["language_id"]
    assert ids["ngram_jaccard_join"] >= {*range(30), 100, 102, *range(200, 205)}
    assert ids["benchmark_decontamination"] == ids["ngram_jaccard_join"] - {102}
    assert ids["best_fit_packing"] == ids["benchmark_decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids["best_fit_packing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _run(spark, path, rows, items, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, value in more.items():
        docs = docs.selectExpr("*", f"{value} AS `{name}`")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_empty_tables(spark, tmp_path):
    """No documents give no pieces; without a benchmark nothing is contaminated."""
    assert _run(spark, tmp_path / "a", [], [(0, "a passage of the benchmark that has more than ten words in it")]) == []


def test_repeated_rows_clashing_columns_and_no_benchmark(spark, tmp_path):
    """Of repeated rows one stays; columns of any name come through; nulls in every column stop nothing.

    Of one line in two documents the first stays, which is that without an id; the other document stays with an empty text.
    """
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("the of and a to in is that it for was on as with be by this are an not they".split()) + rng.choice(["", "", " house", " river", " window"]) for _ in range(60))
    rows = [(i, text(), "en", "s", 1) for i in range(12)]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None), (50, None, None, None, None), (51, "", "en", None, 0)]
    got = _run(spark, tmp_path / "b", rows, [], id="'x'", th="1", term="'y'", leaf="'z'", cls="2", root="'r'", words="'w'", score="'s'", piece="'p'")
    assert {r["doc_id"] for r in got} == {None, *range(12)} and len(got) == 13
    assert [r["length"] for r in got if r["doc_id"] == 4] == [1]
