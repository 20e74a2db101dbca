"""The engine: index, search and ask over repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.lang import parsable
from corpuscle.operators import chat, diff, search, stats
from corpuscle.operators.chunk import build_chunks, dedupe_chunks
from corpuscle.operators.embed import Embedder, HashingEmbedder, embed_column, embed_query, embedded
from corpuscle.operators.parse import parse_files
from corpuscle.operators.split import MAX_TOKENS, OVERLAP_LINES, TokenCounter, count_tokens
from corpuscle.operators.store import ChunkStore
from corpuscle.session import checkpoint, spread
from corpuscle.sources.repo_files import normalise_root, scan


class Engine:
    """Holds a session, a store, an embedder and a generator; paths are normalised on write and on read."""

    def __init__(self, spark: SparkSession, store_path: str, embedder: Embedder | None = None, generator: chat.Generator | None = None, counter: TokenCounter = count_tokens, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_LINES, line_mode: str = "exact"):
        self.spark, self.store = spark, ChunkStore(spark, store_path)
        self.embedder = embedder or HashingEmbedder()
        self.generator = generator or chat.HttpGenerator("llama3")
        self.counter, self.max_tokens, self.overlap, self.line_mode = counter, max_tokens, overlap, line_mode

    def chunks(self, repo_path: str, files: DataFrame | None = None) -> DataFrame:
        """Deduplicated chunks of a repository (or of those of its files), without a store."""
        repo = normalise_root(repo_path)
        sources = scan(self.spark, repo, content=True)
        if files is not None:
            sources = sources.join(F.broadcast(files.select("path")) if files.limit(10_001).count() <= 10_000 else files.select("path"), "path", "left_semi")
        elements = checkpoint(parse_files(sources))  # chunks and their class context both need it
        times = scan(self.spark, repo).select(F.col("path").alias("file_path"), F.col("last_modified").alias("mtime"))
        built = dedupe_chunks(build_chunks(elements, self.counter, self.max_tokens, self.overlap, self.line_mode))
        return built.join(times, "file_path", "left").withColumn("meta", F.col("meta").withField("last_modified", F.col("mtime"))).drop("mtime")

    def index(self, repo_path: str) -> dict[str, int]:
        """Bring the store up to date with a repository and return run statistics.

        Removed and changed files' rows and the new ones are published as one version; files whose
        every embedding failed keep no rows and are tried again next time. Unchanged files are not read.
        """
        repo = normalise_root(repo_path)
        current = parsable(scan(self.spark, repo)).select("repo_path", "path", "last_modified")
        old = self.store.read(repo)
        known = stats.indexed_files(old.withColumn("last_modified", F.col("meta.last_modified"))).withColumnRenamed("file_path", "path")
        plan = checkpoint(diff.classify(current, known))
        counts = plan.groupBy("status").count().collect()
        todo = plan.filter("status in ('new', 'changed')").select("path")
        result = {s: 0 for s in ("new", "changed", "unchanged", "removed")} | {r["status"]: r["count"] for r in counts}
        if not (result["new"] or result["changed"] or result["removed"]):
            return result | {"failed": 0, "total_chunks": self.store.count(repo)}
        made = checkpoint(self.chunks(repo, todo))
        vectors = checkpoint(embed_column(made, "chunk_id", "content", self.embedder))
        fresh = made.join(embedded(vectors), "chunk_id").withColumn("repo_key", F.lit(None).cast("string"))
        failed = vectors.filter("vector is null").count()
        gone = plan.filter("status in ('changed', 'removed')").select(F.col("path").alias("file_path"))
        kept = old.join(gone, "file_path", "left_anti")
        total = self.store.replace_repo(repo, kept.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh.select(*old.columns)))
        return result | {"failed": failed, "total_chunks": total}

    def index_table(self, sources: DataFrame) -> dict[str, int]:
        """:meth:`index` of all repositories of a table of sources (repo_path, path, last_modified, content) at once.

        A repository that has rows is taken to be there whole; others are left as they are. Paths are
        absolute, as a scan gives them. Repeated scans of a file fold into one, the newest. Rows with a
        null repo_path or path name no file.
        """
        given = sources.select(F.regexp_replace("repo_path", "(?<=.)/+$", "").alias("repo_path"), "path", "last_modified", "content").dropna(subset=["repo_path", "path"])
        repos = given.select("repo_path").distinct()
        old = self.store.read().join(repos, "repo_path", "left_semi")
        known = stats.indexed_files(old.withColumn("last_modified", F.col("meta.last_modified"))).withColumnRenamed("file_path", "path")
        plan = checkpoint(diff.classify(parsable(given).select("repo_path", "path", "last_modified"), known))
        result = {s: 0 for s in ("new", "changed", "unchanged", "removed")} | {r["status"]: r["count"] for r in plan.groupBy("status").count().collect()}
        if not (result["new"] or result["changed"] or result["removed"]):
            return result | {"failed": 0, "total_chunks": self.store.count()}
        todo = plan.filter("status in ('new', 'changed')").select("repo_path", "path", F.col("current_time").alias("last_modified"))
        texts = given.join(todo.withColumnRenamed("last_modified", "newest"), ["repo_path", "path"]).filter("last_modified <=> newest").drop("newest")
        # equal copies give equal elements; of unequal ones of one time dedupe keeps the first chunk by key
        elements = checkpoint(parse_files(spread(texts.select("repo_path", "path", "content"))).distinct())
        built = dedupe_chunks(build_chunks(elements, self.counter, self.max_tokens, self.overlap, self.line_mode))
        times = todo.select("repo_path", F.col("path").alias("file_path"), F.col("last_modified").alias("mtime"))
        made = checkpoint(built.join(times, ["repo_path", "file_path"], "left").withColumn("meta", F.col("meta").withField("last_modified", F.col("mtime"))).drop("mtime"))
        # vectors are wide: they are made as the store is written, not kept besides
        vectors = embed_column(made, "chunk_id", "content", self.embedder)
        fresh = made.join(embedded(vectors), "chunk_id").withColumn("repo_key", F.lit(None).cast("string"))
        touched = plan.filter("status <> 'unchanged'").select("repo_path").distinct()
        gone = plan.filter("status in ('changed', 'removed')").select("repo_path", F.col("path").alias("file_path"))
        kept = old.join(touched, "repo_path", "left_semi").join(gone, ["repo_path", "file_path"], "left_anti").join(made.select("chunk_id"), "chunk_id", "left_anti")
        wanted = made.count() + kept.count()
        written = self.store.replace_repos(touched, kept.select(*old.columns).unionByName(fresh.select(*old.columns)))
        return result | {"failed": wanted - written, "total_chunks": self.store.count()}

    def search(self, query: str, top_k: int = 5, repo_path: str | None = None, metric: str = "l2sq") -> DataFrame:
        """Hits of a text, nearest first by ``rank``. A blank text finds nothing."""
        store = self.store.read(repo_path).filter(F.col("embedder_id") == self.embedder.embedder_id)
        if not query.strip():
            return search.top_k(store.limit(0), [0.0] * self.embedder.width, top_k, metric=metric)
        return search.top_k(store, embed_query(query, self.embedder), top_k, metric=metric)

    def ask(self, question: str, repo_path: str | None = None, top_k: int = 5) -> dict:
        """Answer and sources; without hits the generator is told so."""
        hits = [r.asDict(recursive=True) for r in self.search(question, top_k, repo_path).drop("vector").orderBy("rank").collect()]
        return {"answer": self.generator(chat.build_prompt(question, hits)), "sources": hits}
