"""The queries of the training-data operators, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from corpus_pipeline import run as pipeline
from pyspark.sql import DataFrame, SparkSession

from loomstead.llm import chat, decontam, idcoder, license, media, mixing, neardup, packing, quality, spelling, tokens, urls, whitening
from loomstead.llm.common import materialize, read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read(spark, sf_dir, "documents", "doc_id", "text"))


#: Rules on hosts and path prefixes; what they say of pages labels the others.
URL_RULES = (
    urls.Rule("allow", "com"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, depth=None)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media.with_media(read(spark, sf_dir, "documents", "doc_id", "text")))
    return media.describe(stored).drop("timestamps", "random_access")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = idcoder.write_ids(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return idcoder.read_ids(written)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read(spark, sf_dir, "documents", "doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_quality, op2_chat_formatting, op3_license_scan, op4_url_filter, op5_decontamination,
        op6_token_counts, op7_packing, op8_near_duplicates, op9_media, op10_token_ids,
        op11_spelling_variants, op12_whitening, op13_mixing,
    )
    return {f.__name__: f for f in operators} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.ROTATE_SQL, "op3_license_scan": license.scan_sql(), "op4_url_filter": urls.judge_sql(URL_RULES), "op8_near_duplicates": neardup.GROUP_SQL, "op11_spelling_variants": spelling.GROUP_SQL}
