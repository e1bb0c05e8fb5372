"""Readers for the provided parquet tables (column pruning and filter pushdown
happen at the scan because every consumer selects what it needs lazily)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "benchmark", "conversations", "labels", "embeddings", "events", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
