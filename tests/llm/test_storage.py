import pyarrow as pa
from pyspark.sql import functions as F

from catalograin.llm import langid, ngram_join
from catalograin.llm.storage import stored

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_texts_are_bounded(spark, monkeypatch):
    """By bytes, in the write alone, and in the steps that read whole texts."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    docs = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefghi "), 100).alias("text"), F.lit("en").alias("lang"))
    before = spark.conf.get(_KEY)
    found = stored(docs.mapInArrow(sizes, "n long"), "sizes", 100_000).agg(F.max("n"), F.sum("n")).first()
    assert found[0] < 200 and found[1] == 2_000
    assert spark.conf.get(_KEY) == before

    asked = {}
    for module in (ngram_join, langid):
        monkeypatch.setattr(module, "stored", lambda df, tag, batch_bytes=None: asked.update({tag: batch_bytes}) or stored(df, tag, batch_bytes))
    assert ngram_join.ngram_join(docs.limit(3)).count() == 3
    langid.fit(docs.limit(50))
    assert asked["sets"] and asked["tokens"] and asked["seen"]
