"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from numberboard.llm import article, clusters, collocations, decontaminate, jaccard, language, oracles, packing, quality, rules, stupid_backoff, suffix, url_filter, warc
from numberboard.llm.frames import table

#: File of the tokenizer that ``op9`` packs with.
TOKENIZER = "byte_bpe_50k.json"
Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


def op2_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op4_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op5_discriminant_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_merged_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.find_repeats(table(spark, sf_dir, "documents"))


def op7_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff.score_documents(table(spark, sf_dir, "documents"))


def op9_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_redirect_url_filter": (op1_redirect_url_filter, oracles.OP1),
    "op2_ftrl_language": (op2_ftrl_language, None),
    "op3_content_addressed_warc": (op3_content_addressed_warc, oracles.OP3),
    "op4_threshold_rules": (op4_threshold_rules, oracles.OP4),
    "op5_discriminant_quality": (op5_discriminant_quality, None),
    "op6_merged_suffixes": (op6_merged_suffixes, None),
    "op7_prefix_jaccard": (op7_prefix_jaccard, None),
    "op8_stupid_backoff": (op8_stupid_backoff, oracles.OP8),
    "op9_online_packing": (op9_online_packing, None),
    "op10_latent_decontamination": (op10_latent_decontamination, None),
    "op11_toivonen_collocations": (op11_toivonen_collocations, oracles.OP11),
    "op12_sharded_lloyd": (op12_sharded_lloyd, oracles.OP12),
    "op13_tree_scoring": (op13_tree_scoring, None),
}
