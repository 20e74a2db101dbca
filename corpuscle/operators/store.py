"""The chunk store (W1-W6): versioned Parquet with upsert, scoped deletes and atomic publication.

Parquet has no MERGE or DELETE, and a plan cannot overwrite what it reads. A version lists, for each
repository, the directory that holds its rows; a mutation writes only the repositories it touches to
new directories and then replaces the pointer file in one rename. Readers resolve the pointer once, so
they see one version whole, and a crash leaves the old one in place.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.sources.repo_files import normalise_root

META = "struct<parent_class:string,parameters:array<string>,return_type:string,decorators:array<string>,docstring:string,split_segment:int,split_total:int,last_modified:double>"
STORE = f"chunk_id string, repo_path string, file_path string, language string, element_type string, name string, start_line int, end_line int, content string, meta {META}, vector array<float>, embedder_id string, repo_key string"
_COLUMNS = [c.strip().split(" ")[0] for c in STORE.replace(META, "meta").split(", ")]


def repo_key(repo_path: str) -> str:
    """Twelve hex digits for a repository, safe as a directory name."""
    return hashlib.md5(repo_path.encode()).hexdigest()[:12]  # noqa: S324


def flatten(store: DataFrame) -> DataFrame:
    """The record as stored flat: an absent or empty parent_class and repo_path become null."""
    return store.select(
        "chunk_id", "content", "file_path", "element_type", "name", "language", "start_line", "end_line",
        F.nullif("repo_path", F.lit("")).alias("repo_path"), F.nullif(F.col("meta.parent_class"), F.lit("")).alias("parent_class"), F.col("meta.last_modified").alias("last_modified"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Insert or replace by key. ``new`` must have a key once; columns are those of ``old``."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_by_file(store: DataFrame, file_path: str, repo_path: str | None = None) -> DataFrame:
    """What is left without a file's rows, in one repository or (no path given) in all."""
    hit = F.col("file_path") == file_path
    if repo_path:
        hit = hit & (F.col("repo_path") == repo_path)
    return store.filter(~F.coalesce(hit, F.lit(False)))


def delete_by_repo(store: DataFrame, repo_path: str) -> DataFrame:
    """What is left without a repository's rows."""
    return store.filter(~F.coalesce(F.col("repo_path") == repo_path, F.lit(False)))


class ChunkStore:
    """A store under one directory that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, os.path.abspath(path)
        os.makedirs(self.path, exist_ok=True)

    def _pointer(self) -> str:
        return os.path.join(self.path, "current.json")

    def version(self) -> dict[str, str]:
        """Repository key -> directory of the published version."""
        if not os.path.exists(self._pointer()):
            return {}
        with open(self._pointer()) as f:
            return json.load(f)

    def _publish(self, version: dict[str, str]) -> None:
        staged = f"{self._pointer()}.{uuid.uuid4().hex}"
        with open(staged, "w") as f:
            json.dump(version, f)
        os.replace(staged, self._pointer())

    def read(self, repo_path: str | None = None) -> DataFrame:
        """The published rows, of one repository if a path is given; other repositories' files are not opened."""
        version = self.version()
        if repo_path:
            version = {k: v for k, v in version.items() if k == repo_key(normalise_root(repo_path))}
        if not version:
            return self.spark.createDataFrame([], STORE)
        return self.spark.read.schema(STORE).parquet(*(os.path.join(self.path, d) for d in version.values()))

    def replace_repo(self, repo_path: str, rows: DataFrame) -> int:
        """Publish ``rows`` as all of a repository's; without rows the repository leaves the store."""
        key = repo_key(normalise_root(repo_path))
        name = f"data/{key}-{uuid.uuid4().hex[:12]}"
        rows.withColumn("repo_key", F.lit(key)).select(*_COLUMNS).write.parquet(os.path.join(self.path, name))
        count = self.spark.read.parquet(os.path.join(self.path, name)).count()
        version = self.version()
        version.pop(key, None)
        if count:
            version[key] = name
        self._publish(version)
        return count

    def replace_repos(self, repos: DataFrame, rows: DataFrame) -> int:
        """Publish ``rows`` as all of the repositories ``repos`` (repo_path) as one version and return their number; those without rows leave the store.

        Keys are collected, one a repository; rows are written once, by repository.
        """
        name = f"data/{uuid.uuid4().hex[:12]}"
        key = F.substring(F.md5(F.col("repo_path").cast("binary")), 1, 12)
        rows.withColumn("repo_key", key).select(*_COLUMNS).withColumn("part", key).hint("rebalance", "part").write.partitionBy("part").parquet(os.path.join(self.path, name))
        version = self.version()
        for (k,) in repos.select(key).distinct().collect():
            version.pop(k, None)
        made = {d.removeprefix("part="): f"{name}/{d}" for d in os.listdir(os.path.join(self.path, name)) if d.startswith("part=")}
        self._publish(version | made)
        return self.spark.read.schema(STORE).parquet(*(os.path.join(self.path, d) for d in made.values())).count() if made else 0

    def add(self, repo_path: str, rows: DataFrame) -> int:
        """W2 within a repository; an empty table changes nothing."""
        if rows.isEmpty():
            return self.count(repo_path)
        return self.replace_repo(repo_path, upsert(self.read(repo_path), rows.withColumn("repo_key", F.lit(repo_key(normalise_root(repo_path)))).select(*_COLUMNS)))

    def delete_by_file(self, file_path: str, repo_path: str | None = None) -> None:
        """W3."""
        for repo in [normalise_root(repo_path)] if repo_path else self.repos():
            self.replace_repo(repo, delete_by_file(self.read(repo), file_path, repo))

    def delete_files(self, repo_path: str, paths: Iterable[str] | DataFrame) -> None:
        """Many files of one repository at once: one anti join instead of a rewrite a file."""
        gone = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "file_path string")
        self.replace_repo(repo_path, self.read(repo_path).join(gone, "file_path", "left_anti"))

    def delete_by_repo(self, repo_path: str) -> None:
        """Only the pointer changes."""
        version = self.version()
        if version.pop(repo_key(normalise_root(repo_path)), None):
            self._publish(version)

    def repos(self) -> list[str]:
        """Repositories in the store."""
        return sorted(r[0] for r in self.read().select("repo_path").distinct().collect())

    def count(self, repo_path: str | None = None) -> int:
        """A4."""
        return self.read(repo_path).count()
