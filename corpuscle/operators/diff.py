"""Snapshot comparison (F9, J3, J4, U2, U3, A5): what an incremental index has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(current: DataFrame, indexed: DataFrame, keys: tuple[str, ...] = ("repo_path", "path")) -> DataFrame:
    """(keys, current_time, indexed_time, status) of every file of either side.

    Status: ``removed`` (indexed only), ``new`` (current only), ``unchanged`` (both times known and the
    indexed one not older), else ``changed``. Each side needs one row a file with ``last_modified``;
    repeated rows are folded to the newest time. Null keys match nothing and are kept.
    """
    now = current.groupBy(*keys).agg(F.max("last_modified").alias("current_time"), F.lit(True).alias("here"))
    then = indexed.groupBy(*keys).agg(F.max("last_modified").alias("indexed_time"), F.lit(True).alias("there"))
    status = F.when(F.col("here").isNull(), "removed").when(F.col("there").isNull(), "new").when(F.coalesce(F.col("indexed_time") >= F.col("current_time"), F.lit(False)), "unchanged").otherwise("changed")
    return now.join(then, list(keys), "full").withColumn("status", status).drop("here", "there")


def run_statistics(classified: DataFrame, *by: str) -> DataFrame:
    """A5: how many files have each status."""
    return classified.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "unchanged", "removed")))


def removed(current: DataFrame, indexed: DataFrame, keys: tuple[str, ...] = ("repo_path", "path")) -> DataFrame:
    """Distinct files that are indexed but no longer there."""
    return indexed.select(*keys).distinct().join(current.select(*keys).distinct(), list(keys), "left_anti")
