"""A corpus pipeline of five stages, each one of the training-data operators; counted with glyphmill.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() chains them over documents. On a cluster
each stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphmill.llm import decontaminate, language_id, line_dedup, near_copies, piece_codec, simhash
from glyphmill.llm.common import cut, table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Phrases a byte from which a text is no learned language: on average under two letters of it occur there together.
MAX_PHRASE_RATE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without letters, and those that no language's text resembles, go."""
    judged = language_id.identify(docs)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("phrase_rate") <= MAX_PHRASE_RATE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; a document that loses all it had goes."""
    out = line_dedup.line_dedup(docs)
    kept = out.where((F.col("n_dropped") == 0) | (F.length(F.btrim("kept", F.lit(line_dedup.BLANKS))) > 0))
    cut_text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns({"text": cut_text, "n_chars": n_chars}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more), the smallest id."""
    return simhash.first_of_groups(docs, near_copies.near_groups(docs)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids: doc_id, lang, source, n_ids, ids, round_trip."""
    return piece_codec.encode(docs, TOKENIZER, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]

ORACLE_SQL = None  # automata, XXH64 fingerprints and a tokenizer's merges are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
