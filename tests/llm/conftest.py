import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    long_text = " ".join(f"word{i % 5000}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \n\t \n", "en", None, None),
        (4, "one two three", "en", "b", 13),
        (4, "one two three", "en", "b", 13),
        (None, "one two three", None, None, None),
        (5, long_text, "en", "b", len(long_text)),
        (6, "Ünïcödé wörds ünd 𝒳 more Ünïcödé wörds", "de", "b", 20),
        (7, "12345 67890 !!!", "en", "c", 15),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("id", "uid", "word", "words", "pos", "term", "h", "cls", "n", "token", "leaf", "shard", "slot", "chunk", "size", "bin", "score", "lang_pred"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def near_docs():
    """(doc_id, text): groups of edited copies, chains of them, exact copies, and unrelated texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 60, 150]))]
        for copy in range(rng.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if copy % 4 == 3:
                base = text  # a chain
            rows.append((n, " ".join(text)))
            n += 1
    return rows
