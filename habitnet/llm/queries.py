"""The registered queries of this package: ``(spark, sf_dir) -> DataFrame``.

Each applies an operator, with its production parameters, to a whole table and
derives the columns of its contract from the operator's results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.llm import (
    alignment,
    byte_lm,
    decontaminate,
    inner_products,
    line_dedup,
    packing,
    quality_model,
    quality_rules,
    resampling,
    simhash,
    token_files,
    toxicity,
    warc,
)
from habitnet.llm.common import scratch_path, stored, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


PACK_LENGTH = 2048
PACK_END_ID = 1


def packed_pieces(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), PACK_END_ID, PACK_LENGTH)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    records = stored(warc.read(spark, path, payloads=False), "warc-records")
    return warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_byte_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_lm.score(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.digests(spark, path)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.link_counts(table(spark, sf_dir, "documents"), *files)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return inner_products.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_model": op4_quality_model,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_byte_lm": op9_byte_lm,
    "op10_token_files": op10_token_files,
    "op11_alignment": op11_alignment,
    "op12_top_k": op12_top_k,
    "op13_resample": op13_resample,
}
