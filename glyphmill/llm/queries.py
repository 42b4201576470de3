"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hmm, language_id, license_scan, line_dedup, merkle, piece_codec, simhash, substring_dedup, url_filter, vector_search, warc, whitening
from .common import table

#: A public sentencepiece BPE model; every operator takes its path as a parameter.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_search": lambda spark, d: vector_search.op1_vector_search(table(spark, d, "embeddings")),
    "op2_language_id": lambda spark, d: language_id.op2_language_id(table(spark, d, "documents")),
    "op3_simhash": lambda spark, d: simhash.op3_simhash(table(spark, d, "documents")),
    "op4_url_filter": lambda spark, d: url_filter.op4_url_filter(table(spark, d, "pages")),
    "op5_line_dedup": lambda spark, d: line_dedup.op5_line_dedup(table(spark, d, "documents")),
    "op6_license_scan": lambda spark, d: license_scan.op6_license_scan(table(spark, d, "documents")),
    "op7_piece_codec": lambda spark, d: piece_codec.op7_piece_codec(table(spark, d, "documents"), TOKENIZER),
    "op8_decontaminate": lambda spark, d: decontaminate.op8_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_substring_dedup": lambda spark, d: substring_dedup.op9_substring_dedup(table(spark, d, "documents")),
    "op10_warc": lambda spark, d: warc.op10_warc(table(spark, d, "pages")),
    "op11_merkle": lambda spark, d: merkle.op11_merkle(table(spark, d, "documents")),
    "op12_whitening": lambda spark, d: whitening.op12_whitening(table(spark, d, "embeddings")),
    "op13_language_model": lambda spark, d: hmm.op13_language_model(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op5_line_dedup": line_dedup.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op10_warc": warc.SQL,
    "op11_merkle": merkle.SQL,
}
