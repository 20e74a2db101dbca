"""Counts and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by_extension(files: DataFrame) -> DataFrame:
    """A1, O2: files by extension (lower case), in order; null is an extension of its own."""
    return files.groupBy(F.lower("extension").alias("extension")).agg(F.count("*").alias("files")).orderBy("extension")


def total_size(files: DataFrame, *by: str) -> DataFrame:
    """A2: bytes of all files, by the given columns; 0 where none has a size."""
    return files.groupBy(*by).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size"))


def store_counts(store: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A4: distinct chunks of each repository, and of all under a null repo_path."""
    ids = store.select("repo_path", key).distinct()
    return ids.groupBy("repo_path").agg(F.count("*").alias("chunks")).unionByName(store.select(key).distinct().agg(F.count("*").alias("chunks")).select(F.lit(None).cast("string").alias("repo_path"), "chunks"))


def indexed_files(store: DataFrame) -> DataFrame:
    """The newest modification time of each stored file; rows without path or time are ignored."""
    return store.dropna(subset=["file_path", "last_modified"]).groupBy("repo_path", "file_path").agg(F.max("last_modified").alias("last_modified"))


def batch_totals(sources: DataFrame) -> DataFrame:
    """Files read, failed, lines and bytes."""
    ok = F.col("error").isNull() & F.col("content").isNotNull()
    return sources.agg(F.count_if(ok).alias("read"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("line_count"))), F.lit(0)).cast("bigint").alias("lines"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).cast("bigint").alias("bytes"))
