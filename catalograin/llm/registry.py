"""The queries of this subpackage: production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extraction, fim, langid, line_dedup, quality, token_counts, vector_codes
from .ngram_join import ORACLE as NGRAM_ORACLE
from .ngram_join import ngram_join
from .packing import pack_documents
from .sharding import shard_documents
from .urlfilter import Rule, judge_urls
from .urlfilter import oracle as url_oracle
from .vector_join import ORACLE as VECTOR_ORACLE
from .vector_join import near_vectors

PACK_TOKENIZER = "word_bpe_49k.json"
COUNT_PIECES = "piece_bpe_32k.model"
URL_RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), within=decontaminate.WITHIN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.unigram_pieces(public_tokenizers.path(COUNT_PIECES))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), pieces)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), spans=False)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_spans")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_TOKENIZER))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_quality_rules": op4_quality_rules,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_html_extraction": op6_html_extraction,
        "op7_url_filters": op7_url_filters,
        "op8_language_id": op8_language_id,
        "op9_sharding": op9_sharding,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_embedding_near_dedup": op11_embedding_near_dedup,
        "op12_vector_code_compression": op12_vector_code_compression,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op2_benchmark_decontamination": decontaminate.near_oracle(),
        "op5_ngram_jaccard_join": NGRAM_ORACLE,
        "op7_url_filters": url_oracle(URL_RULES),
        "op11_embedding_near_dedup": VECTOR_ORACLE,
        "op12_vector_code_compression": vector_codes.oracle(),
        "op13_fill_in_middle": fim.ORACLE,
    }
