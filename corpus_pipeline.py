"""Corpus pipeline: from raw documents to token counts and digests, by five of the training-data operators.

Each stage works on all that the stage before kept, is written as Parquet under
the shared checkpoint folder and read again, so a lost executor repeats part of
one stage only.  All stages but the last return the columns of ``documents``; the
last returns ``mix_key`` beside its own columns, so that the order of the mix
does not hang on how files are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import bpe, mixing, neardup, paragraphs
from spanlake.llm import queries as Q
from spanlake.llm import tables as TA


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality vote rejects."""
    scored = Q.quality_scores(docs, Q.read(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= Q.KEEP_QUALITY).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return neardup.drop_near_duplicates(docs, neardup.Similarity())


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that repeat an earlier place; ``n_chars`` follows the text."""
    out = paragraphs.paragraph_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into the order of the source mix."""
    return mixing.mix_sources(docs).orderBy("mix_key").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts; sort by ``mix_key`` for the mixed order."""
    rows = docs.select(F.struct("doc_id", "source").alias("of"), "text")
    out = TA.written(bpe.encode_documents(rows, Q.rank_file(), id_col="of"), "encoded")
    out = mixing.mix_sources(out.select("of.doc_id", "of.source", *out.columns[1:]))  # the same rows have the same keys again; no text travels
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mix_key")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
ORACLE_SQL = None  # SQL cannot express the fitted vote; tests hold the stages against brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = Q.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = TA.written(stage(spark, docs, sf_dir), name)
    return docs
