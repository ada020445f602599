"""Ingest of repository items from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.text import file_name


def ingest_items(spark: SparkSession, glob: str, defaults: dict | None = None) -> DataFrame:
    """(item_name, item_version, item_content, …) from binary files; version null = to be resolved."""
    d = {"item_type": "POWERSHELL", "item_version": None, "tags": None, "description": None, "is_enabled": True, **(defaults or {})}
    files = spark.read.format("binaryFile").load(glob)
    return files.select(
        "path",
        file_name("path").alias("item_name"),
        F.col("content").alias("item_content"),
        F.col("length").alias("item_bytes"),
        *[F.lit(v).cast("boolean" if k == "is_enabled" else "string").alias(k) for k, v in d.items()],
    )
