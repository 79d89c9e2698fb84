"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import cut, delete, new_path, shared_dir

__all__ = ["SPACES", "cut", "delete", "documents", "new_path", "shared_dir"]

#: Characters between words: space and tab to carriage return.
SPACES = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
