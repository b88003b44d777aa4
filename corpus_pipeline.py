"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

1. quality classifier: documents scored below 0.5 go;
2. SimHash near-dedup: of each group at two or fewer differing bits one document stays;
3. suffix-array dedup: 50-byte strings that an earlier document also holds are cut out;
4. mixing: sources to target weights, documents taken in blocks of words, up to twice;
5. SentencePiece: the ids of every text.

Every stage but the last returns the columns of ``documents``; ``run`` writes each result as
Parquet into the shared folder and reads it back for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm import mixing, quality, sentencepiece_codec, simhash, suffix_dedup
from labelflow.llm.common import DOCUMENT_COLUMNS, prepare, table, written
from labelflow.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5, learnt from the labelled ones that are not
    held out."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")) \
        .where(~quality.held_out())
    weights = quality.fit(docs, labels)
    scored = quality.score(docs.select(*DOCUMENT_COLUMNS), weights, out="_score")
    return scored.where(F.col("_score") >= 0.5).select(*DOCUMENT_COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id (null last; among
    rows of one doc_id the smallest content hash; of fully equal rows one)."""
    prepare(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    content = F.xxhash64(*DOCUMENT_COLUMNS, *[F.col(c).isNull() for c in DOCUMENT_COLUMNS])
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                    content.alias("hash"))
    grouped = simhash.near_duplicate_groups(docs.select(rank.alias("key"), "text"),
                                            key_col="key", shingle=3, radius=2)
    stay = grouped.where(F.col("key") == F.col("component_id")) \
        .select(F.col("key.hash").alias("_hash")).distinct()
    return docs.withColumn("_hash", content).join(stay, "_hash", "left_semi") \
        .dropDuplicates(["_hash"]).select(*DOCUMENT_COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document of smaller doc_id also holds."""
    prepare(spark)
    left = suffix_dedup.remove_repeats(docs.select(*DOCUMENT_COLUMNS), length=50, as_text=True)
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                       F.char_length("kept").cast("bigint").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: one row per document and pass with the words taken."""
    prepare(spark)
    _, pieces, texts, _ = mixing.mix(docs.select(*DOCUMENT_COLUMNS), [3, 1, 2], share=1.5)
    return mixing.mixed_documents(pieces, texts).select(*DOCUMENT_COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    prepare(spark)
    return sentencepiece_codec.add_ids(
        docs.select("doc_id", "text", "lang", "source", "n_chars"),
        tokenizer_path("piece_bpe_32k.model")) \
        .withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece encoding", encode_stage),
]

#: SQL cannot express the hashes, the fitted model and the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs = written(docs, "stage")
        docs = stage(spark, docs, sf_dir)
    return docs
