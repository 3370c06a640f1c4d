import corpus_pipeline
from catalograin.llm import registry


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
