"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskflow.llm import compression, divergence, forest, html, lm, mixing, multiset, neighbours, oracles, packing, secrets, simhash, trie, urls
from maskflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


# Fixed values of the query.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op2_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("text")


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_nearest_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return compression.classify(docs.select("doc_id", "text"), labels).drop("text")


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.label(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def llm_queries() -> dict[str, Query]:
    found = [
        op1_path_template_tree,
        op2_linked_secrets,
        op3_temperature_mixing,
        op4_nn_descent,
        op5_nearest_url_differencing,
        op6_simhash_near_dedup,
        op7_compression_quality,
        op8_multiset_hash,
        op9_mixture_packing,
        op10_log_bilinear,
        op11_conversation_trie,
        op12_lsh_forest,
        op13_source_divergence,
    ]
    return {query.__name__: query for query in found}


def llm_sql() -> dict[str, str]:
    return {"op11_conversation_trie": oracles.OP11, "op12_lsh_forest": oracles.OP12, "op13_source_divergence": oracles.OP13}
