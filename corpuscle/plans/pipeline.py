"""Queries of the pipeline's steps: scan, read, decode, parse, split, chunk, embed, store, engine."""

from __future__ import annotations

import hashlib
import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import lang, text
from corpuscle.functions.arrow import map_columns
from corpuscle.operators import chat, chunk, embed, parse, split
from corpuscle.plans import oracles
from corpuscle.plans.engine import Engine
from corpuscle.plans.registry import query
from corpuscle.session import checkpoint, shared_path, spread, table
from corpuscle.sources import repo_files


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest scan of each file that has content."""
    s = table(spark, sf_dir, "sources").select("repo_path", "path", "last_modified", "content").dropna(subset=["repo_path", "path", "content"])
    newest = F.max_by(F.struct("last_modified", "content"), F.struct("last_modified", "content")).alias("s")
    return s.groupBy("repo_path", "path").agg(newest).select("repo_path", "path", "s.*")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, "[ \\t\\n\\x0B\\f\\r]+", "")


def _core(c: Column) -> Column:
    return F.regexp_replace(c, "(\\n[ \\t]*#[^\\n]*|[ \\t\\n\\x0B\\f\\r])+$", "")


def _clean_files(elements: DataFrame, newest: DataFrame) -> DataFrame:
    """Files whose elements all stand in the newest scan at their lines; others have elements of an earlier state."""
    stated = elements.select("repo_path", "path", "start_line", "end_line", F.col("content").alias("part")).distinct()
    lines = F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    here = F.contains(_squeezed(F.array_join(lines, "")), _squeezed(F.col("part")))
    return stated.join(newest, ["repo_path", "path"]).groupBy("repo_path", "path").agg(F.every(here).alias("clean")).filter("clean")


def _shape(e: DataFrame) -> DataFrame:
    """What parser and table agree on: keys, lines, wording, parents, parameters without types, results, decorators."""
    names = F.transform(F.coalesce("parameters", F.array().cast("array<string>")), lambda p: F.trim(F.regexp_extract(p, "^[^?:=]*", 0)))
    return e.select(
        "repo_path", "path", "type", "name", F.col("start_line").cast("bigint").alias("start_line"), (F.col("start_line") + F.length(_core(F.col("content"))) - F.length(F.replace(_core(F.col("content")), F.lit("\n"), F.lit("")))).cast("bigint").alias("end_line"),
        F.md5(F.regexp_replace(_squeezed(_core(F.col("content"))), "^export(default)?", "")).alias("digest"), "parent_class", F.array_join(names, ",").alias("parameters"), "return_type", F.array_join("decorators", ",").alias("decorators"),
    ).distinct()


_SHAPE = f"SELECT DISTINCT repo_path, path, type, name, CAST(start_line AS BIGINT) AS start_line, CAST(start_line + length({oracles.core('content')}) - length(replace({oracles.core('content')}, chr(10), '')) AS BIGINT) AS end_line, md5(regexp_replace({oracles.squeezed(oracles.core('content'))}, '^export(default)?', '')) AS digest, parent_class, coalesce(array_to_string(parameters, ','), '') AS parameters, return_type, coalesce(array_to_string(decorators, ','), '') AS decorators FROM elements"


@query(f"WITH {oracles.NEWEST}, {oracles.CLEAN} {_SHAPE} SEMI JOIN clean USING (repo_path, path)")
def q42_parse(spark, sf_dir):
    """Elements parsed from the sources, of the files whose listed elements are of the same state.

    The SQL reads the listed elements: at sf0.01 478 of 492 files with elements are of their newest
    state, at sf0.1 4,867 of 5,032, of which two no longer parse.
    """
    newest = checkpoint(_newest(spark, sf_dir))
    return _shape(parse.parse_files(spread(newest)).join(_clean_files(table(spark, sf_dir, "elements"), newest), ["repo_path", "path"], "left_semi"))


@query(f"WITH {oracles.NEWEST}, {oracles.CLEAN} SELECT DISTINCT repo_path, path, name, CAST(start_line AS BIGINT) AS start_line, md5({oracles.squeezed('docstring')}) AS digest FROM elements SEMI JOIN clean USING (repo_path, path) WHERE type IN ('class', 'function', 'method') AND length(docstring) > 0 AND (language = 'python' OR starts_with(docstring, '/**'))")
def q57_docstrings(spark, sf_dir):
    """Docstrings and doc comments as parsed, of the elements for which one is listed.

    Plain comments, which the table lists as well, are none to the parsers.
    """
    newest = checkpoint(_newest(spark, sf_dir))
    elements = table(spark, sf_dir, "elements")
    listed = elements.filter("type in ('class', 'function', 'method') and length(docstring) > 0 and (language = 'python' or startswith(docstring, '/**'))").select("repo_path", "path", "name", "start_line").distinct().join(_clean_files(elements, newest), ["repo_path", "path"], "left_semi")
    parsed = parse.parse_files(spread(newest)).filter("type <> 'import'").join(listed, ["repo_path", "path", "name", "start_line"], "left_semi")
    return parsed.select("repo_path", "path", "name", F.col("start_line").cast("bigint").alias("start_line"), F.md5(_squeezed(F.col("docstring"))).alias("digest")).distinct()


@query(oracles.pieces() + " SELECT DISTINCT repo_path, path, type, name, CAST(start_line AS BIGINT) AS start_line, coalesce(segment, -1) AS segment, coalesce(segments, -1) AS segments, CAST(segment_start AS BIGINT) AS segment_start, CAST(segment_end AS BIGINT) AS segment_end, md5(piece) AS digest FROM pieces")
def q43_split(spark, sf_dir):
    """K1-K8: elements cut to the token budget, line by line."""
    made = split.split_elements(spread(table(spark, sf_dir, "elements").filter("type <> 'import'")))
    numbers = [F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("start_line", "segment", "segments", "segment_start", "segment_end")]
    return made.select("repo_path", "path", "type", "name", *numbers, F.md5("content").alias("digest")).distinct()


def _chunk_columns(made: DataFrame) -> DataFrame:
    return made.select("chunk_id", "file_path", "element_type", "name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.md5("content").alias("digest"), F.col("meta.parent_class").alias("parent_class"), F.coalesce("meta.split_segment", F.lit(-1)).cast("bigint").alias("split_segment"), F.coalesce("meta.split_total", F.lit(-1)).cast("bigint").alias("split_total"))


_MADE = " SELECT chunk_id, file_path, element_type, name, start_line, end_line, md5(content) AS digest, parent_class, coalesce(split_segment, -1) AS split_segment, coalesce(split_total, -1) AS split_total FROM made"


@query(oracles.chunks() + _MADE)
def q44_chunks(spark, sf_dir):
    """Chunks built from the elements, deduplicated."""
    return _chunk_columns(chunk.dedupe_chunks(chunk.build_chunks(table(spark, sf_dir, "elements").distinct())))


@query(oracles.chunks(128, 3, "compat") + _MADE)
def q49_compatible_chunks(spark, sf_dir):
    """K4-K11 with the lines and ids of split chunks as they were before, and a budget of 128 tokens."""
    return _chunk_columns(chunk.dedupe_chunks(chunk.build_chunks(table(spark, sf_dir, "elements").distinct(), budget=128, line_mode="compat")))


#: Files from which trees are written in groups of repositories, and most groups: only one stands on disk at a time.
GROUP_FILES, GROUPS = 10_000, 4
#: Files that a task writes, where two tasks would have more. A file system makes names one at a time: on the build machine six writers took twice the time of two and five times their CPU seconds.
WRITER_FILES = 100_000


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sources").select("repo_path", "path", "last_modified", "content").dropna(subset=["repo_path", "path"])


def _repo_groups(spark: SparkSession, sf_dir: str) -> list[list[str]]:
    """All repositories of the sources in groups of about as many rows; repositories are few beside files."""
    counts = _named(spark, sf_dir).groupBy("repo_path").count().collect()
    groups: list[list[str]] = [[] for _ in range(max(1, min(GROUPS, sum(r["count"] for r in counts) // GROUP_FILES, len(counts))))]
    held = [0] * len(groups)
    for r in sorted(counts, key=lambda r: (-r["count"], r["repo_path"])):
        least = held.index(min(held))
        groups[least].append(r["repo_path"])
        held[least] += r["count"]
    return [sorted(g) for g in groups]


def _tree(spark: SparkSession, sf_dir: str, folder: str, repos: list[str] | None = None) -> None:
    """Write the newest scans of all files, or of those of some repositories, as trees; files without content are links to nowhere."""
    s = _named(spark, sf_dir)
    s = s if repos is None else s.filter(F.col("repo_path").isin(repos))
    newest = F.max_by(F.struct("last_modified", "content"), F.struct(F.col("content").isNotNull(), "last_modified", "content")).alias("s")
    os.makedirs(folder, exist_ok=True)
    # what lies under one directory of a root is folded and written by one task
    tasks = max(2, s.count() // WRITER_FILES)
    placed = s.withColumn("top", F.substring_index("path", "/", 1)).repartition(tasks, "repo_path", "top")
    repo_files.write_tree(placed.groupBy("repo_path", "top", "path").agg(newest).select("repo_path", "path", "s.*"), folder)


_FILES = f"""WITH {oracles.NEWEST}, t AS (
  SELECT repo_path, path, regexp_extract(path, '[^/]+$') AS name, lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) AS extension, CAST(strlen(content) AS BIGINT) AS size, CAST(floor(coalesce(last_modified, 0)) AS BIGINT) AS modified,
    string_split(path, '/')[:-2] AS folders, regexp_replace(regexp_replace(content, '^\\x{{FEFF}}', ''), '\\r\\n?', chr(10), 'g') AS body, CASE WHEN starts_with(content, chr(65279)) THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding FROM newest)"""
_LISTED = "repo_path, path, name, extension, size, modified"
_BODY = f"encoding, {oracles.line_count('body')} AS line_count, md5(body) AS digest"
_DEFAULT = f"NOT list_has_any(folders, [{', '.join(repr(d) for d in repo_files.IGNORED_DIRS)}]) AND extension IN ({', '.join(repr(e) for e in repo_files.EXTENSIONS)})"


@query(
    f"{_FILES} SELECT 'full' AS mode, {_LISTED}, {_BODY}, CAST(NULL AS VARCHAR) AS error FROM t WHERE {_DEFAULT} UNION ALL SELECT 'flat', {_LISTED}, NULL, -1, NULL, NULL FROM t WHERE len(folders) = 0 AND {_DEFAULT} "
    f"UNION ALL SELECT 'custom', {_LISTED}, NULL, -1, NULL, NULL FROM t WHERE NOT list_contains(folders, 'src') AND extension IN ('.py', '.ts') AND size <= 3000 "
    f"UNION ALL SELECT 'checked', {_LISTED}, CASE WHEN size <= 2000 THEN encoding END, CASE WHEN size <= 2000 THEN {oracles.line_count('body')} ELSE -1 END, CASE WHEN size <= 2000 THEN md5(body) END, CASE WHEN size > 2000 THEN 'larger than 2000 bytes' END FROM t WHERE {_DEFAULT}"
)
def q45_repo_scan(spark, sf_dir):
    """The sources written out as trees and scanned in four ways.

    ``full`` reads all, ``flat`` lists the roots' own files, ``custom`` has other directories, suffixes
    and a size limit, ``checked`` a limit on what is read. Unreadable files are passed over. Small files
    take many times their size on disk, so repositories are written, scanned and removed in groups.
    """
    folder = shared_path(spark, "tree")
    extra = ("encoding", "line_count", "digest", "error")

    def listed(roots: list[str], mode: str, content: bool = False, **options: str) -> DataFrame:
        got = repo_files.scan(spark, roots, content=content, **options)
        if content:
            got = got.withColumn("digest", F.md5("content"))
        missing = {c: F.lit(None).cast("bigint" if c == "line_count" else "string") for c in extra if not content}
        got = got.withColumns(missing).withColumn("line_count", F.coalesce("line_count", F.lit(-1)))
        repo = F.substring("repo_path", len(folder) + 1, 1 << 20)
        return got.select(F.lit(mode).alias("mode"), repo.alias("repo_path"), "path", "name", "extension", "size", F.floor("last_modified").cast("bigint").alias("modified"), *extra)

    out = None
    for repos in _repo_groups(spark, sf_dir):
        _tree(spark, sf_dir, folder, repos)
        roots = [os.path.join(folder, r.lstrip("/")) for r in repos]
        parts = listed(roots, "full", True), listed(roots, "flat", recursive="false"), listed(roots, "custom", ignore="src", extensions=".py,.ts", maxFileSize="3000"), listed(roots, "checked", True, readerLimit="2000", rejectBinary="true")
        done = checkpoint(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
        repo_files.remove_trees(spark, roots)
        out = done if out is None else out.unionByName(done)
    shutil.rmtree(folder)
    return out


@query(f"{_FILES}, l AS (SELECT DISTINCT repo_path, path FROM files WHERE repo_path IS NOT NULL AND path IS NOT NULL) SELECT 'listed' AS mode, repo_path, path, encoding, coalesce({oracles.line_count('body')}, -1) AS line_count, md5(body) AS digest, encoding IS NULL AS failed FROM l LEFT JOIN t USING (repo_path, path) UNION ALL SELECT 'raw', repo_path, path, 'utf-8', {oracles.line_count('body')}, CASE WHEN encoding = 'utf-8' THEN md5(body) END, false FROM t")
def q50_read_paths(spark, sf_dir):
    """The files of a listing read in a batch, and raw reads with a named encoding."""
    folder = shared_path(spark, "tree")
    _tree(spark, sf_dir, folder)
    paths = table(spark, sf_dir, "files").select("repo_path", "path").dropna().distinct()
    listed = repo_files.read_files(spread(paths), folder)
    raw = repo_files.read_files(spread(_newest(spark, sf_dir).select("repo_path", "path")), folder, encoding="utf-8")
    columns = "repo_path", "path", "encoding", F.coalesce("line_count", F.lit(-1)).cast("bigint").alias("line_count")
    a = listed.select(F.lit("listed").alias("mode"), *columns, F.md5("content").alias("digest"), F.col("error").isNotNull().alias("failed"))
    b = raw.select(F.lit("raw").alias("mode"), *columns, F.when(~F.startswith("content", F.lit("﻿")), F.md5("content")).alias("digest"), F.col("error").isNotNull().alias("failed"))
    out = checkpoint(a.unionByName(b))
    shutil.rmtree(folder)
    return out


@query(oracles.vectors("(SELECT DISTINCT chunk_id AS key, content AS txt FROM chunks WHERE chunk_id IS NOT NULL)").join(["WITH ", " SELECT key AS chunk_id, CAST(dim AS BIGINT) AS dim, CAST(value AS DOUBLE) AS value FROM vecs UNION ALL SELECT chunk_id, -1, 0.0 FROM (SELECT DISTINCT chunk_id, content FROM chunks WHERE chunk_id IS NOT NULL) WHERE chunk_id NOT IN (SELECT key FROM vecs)"]))
def q46_embed(spark, sf_dir):
    """Chunks embedded by the offline embedder, the dimensions that are not 0; failures have dimension -1."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "content").filter("chunk_id is not null").distinct()
    made = embed.embed_column(spread(chunks), "chunk_id", "content", embed.HashingEmbedder())
    return made.select("chunk_id", F.posexplode_outer("vector").alias("dim", "value")).filter("value is null or value <> 0").select("chunk_id", F.coalesce("dim", F.lit(-1)).cast("bigint").alias("dim"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


_UTF8 = r"^(?:[\x00-\x7f]|[\x{c2}-\x{df}][\x{80}-\x{bf}]|\x{e0}[\x{a0}-\x{bf}][\x{80}-\x{bf}]|[\x{e1}-\x{ec}\x{ee}\x{ef}][\x{80}-\x{bf}]{2}|\x{ed}[\x{80}-\x{9f}][\x{80}-\x{bf}]|\x{f0}[\x{90}-\x{bf}][\x{80}-\x{bf}]{2}|[\x{f1}-\x{f3}][\x{80}-\x{bf}]{3}|\x{f4}[\x{80}-\x{8f}][\x{80}-\x{bf}]{2})*$"
_DECODED = "(SELECT *, regexp_replace(regexp_replace(content, '^\\x{FEFF}', ''), '\\r\\n?', chr(10), 'g') AS body FROM (SELECT DISTINCT repo_path, path, content FROM sources WHERE content <> ''))"


@query(
    f"SELECT DISTINCT v.variant, repo_path, path, CASE v.variant WHEN 'utf16' THEN 'utf-16' WHEN 'utf8' THEN CASE WHEN starts_with(content, chr(65279)) THEN 'utf-8-sig' ELSE 'utf-8' END ELSE CASE WHEN regexp_matches(content, '{_UTF8}') THEN 'utf-8' ELSE 'latin-1' END END AS encoding, CASE WHEN v.variant = 'latin1' AND regexp_matches(content, '{_UTF8}') THEN NULL ELSE md5(body) END AS digest, CASE WHEN v.variant = 'latin1' AND regexp_matches(content, '{_UTF8}') THEN -1 ELSE {oracles.line_count(oracles.ended('body'))} END AS lines "
    f"FROM {_DECODED} s JOIN (VALUES ('utf8'), ('utf16'), ('latin1')) v(variant) ON v.variant <> 'latin1' OR regexp_matches(content, '^[\\x00-\\x{{ff}}]*$') AND NOT regexp_matches(content, '^[\\x00-\\x7f]*$')"
)
def q47_decode(spark, sf_dir):
    """Contents as bytes in three encodings, decoded by detection and the ladder.

    latin-1 bytes that happen to be valid UTF-8 are taken for it; their text has no digest here.
    """
    codecs = {"utf8": "utf-8", "utf16": "utf-16", "latin1": "latin-1"}

    def run(repos: list, paths: list, contents: list) -> dict[str, list]:
        rows = []
        for repo, path, content in zip(repos, paths, contents):
            for variant, codec in codecs.items():
                if variant == "latin1" and (content.isascii() or max(content) > "\xff"):
                    continue
                got, used = text.decode_bytes(content.encode(codec))
                known = variant != "latin1" or used != "utf-8"
                rows.append((variant, repo, path, used, hashlib.md5(got.encode()).hexdigest() if known else None, len(got.splitlines()) if known else -1))
        return {n: [r[i] for r in rows] for i, n in enumerate(("variant", "repo_path", "path", "encoding", "digest", "lines"))}

    rows = table(spark, sf_dir, "sources").filter("content <> ''").select("repo_path", "path", "content")
    return map_columns(spread(rows), ["repo_path", "path", "content"], run, "variant string, repo_path string, path string, encoding string, digest string, lines bigint").distinct()


_SCANNED = "(SELECT regexp_replace(repo_path, '(.)/+$', '\\1') AS repo_path, path, CASE lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lang.LANGUAGES.items()) + " END AS language FROM sources WHERE repo_path IS NOT NULL AND path IS NOT NULL)"


@query(
    f"WITH c AS (SELECT DISTINCT repo_path, path FROM {_SCANNED} WHERE language IN ('python', 'javascript', 'typescript', 'tsx')) SELECT 'first' AS run, 'new' AS status, count(*) AS files FROM c UNION ALL SELECT 'first', s, 0 FROM (VALUES ('changed'), ('unchanged'), ('removed')) v(s) UNION ALL SELECT 'again', 'new or unchanged', count(*) FROM c UNION ALL SELECT 'again', s, 0 FROM (VALUES ('changed'), ('removed')) v(s)"
)
def q48_engine(spark, sf_dir):
    """All repositories of the sources indexed into a fresh store in the cluster's shared folder, twice.

    A file without elements keeps no rows and is new again; all others are unchanged.
    """
    folder = shared_path(spark, "engine")
    engine = Engine(spark, folder)
    first = engine.index_table(table(spark, sf_dir, "sources"))
    again = engine.index_table(table(spark, sf_dir, "sources"))
    shutil.rmtree(folder)
    if first["total_chunks"] != again["total_chunks"]:
        raise AssertionError("a second run changed the store")
    rows = [("first", s, first[s]) for s in ("new", "changed", "unchanged", "removed")] + [("again", "new or unchanged", again["new"] + again["unchanged"]), ("again", "changed", again["changed"]), ("again", "removed", again["removed"])]
    return spark.createDataFrame(rows, "run string, status string, files bigint")


_QUESTION = "how are cargo manifests counted in the warehouse index"
_CHUNKS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY repo_path NULLS FIRST, file_path NULLS FIRST, start_line NULLS FIRST, name NULLS FIRST, content NULLS FIRST) AS place FROM chunks WHERE chunk_id IS NOT NULL AND repo_path IS NOT NULL) WHERE place = 1)"
_HITS = (
    f"WITH texts AS MATERIALIZED (SELECT chunk_id AS key, content AS txt FROM {_CHUNKS} UNION ALL SELECT '?', '{_QUESTION}'), {oracles.vectors('texts')}, "
    f"near AS (SELECT v.key, sum(power(coalesce(CAST(v.value AS DOUBLE), 0) - 0, 2)) AS own, sum(CAST(v.value AS DOUBLE) * coalesce(CAST(q.value AS DOUBLE), 0)) AS dot FROM vecs v LEFT JOIN vecs q ON q.key = '?' AND q.dim = v.dim WHERE v.key <> '?' GROUP BY 1), "
    f"one AS (SELECT sum(power(CAST(value AS DOUBLE), 2)) AS own FROM vecs WHERE key = '?'), big AS (SELECT repo_path FROM {_CHUNKS} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
    f"hits AS MATERIALIZED (SELECT c.*, round(near.own - 2 * dot + one.own, 6) AS distance FROM near JOIN {_CHUNKS} c ON c.chunk_id = near.key, one)"
)
_TOP = "SELECT {0} AS scope, chunk_id, name, distance, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM hits {1} ORDER BY distance, chunk_id LIMIT 5"


def _filled(spark: SparkSession, sf_dir: str, folder: str) -> tuple[Engine, str]:
    """(engine over a store of the chunks with their vectors, largest repository); a context is its own answer."""
    c = table(spark, sf_dir, "chunks").filter("chunk_id is not null and repo_path is not null")
    first = checkpoint(chunk.keep_first(c, "chunk_id", "repo_path", "file_path", "start_line", "name", "content"))
    engine = Engine(spark, folder, generator=lambda prompt: prompt)
    vectors = embed.embedded(embed.embed_column(spread(first), "chunk_id", "content", engine.embedder))
    engine.store.replace_repos(first.select("repo_path").distinct(), first.join(vectors, "chunk_id"))
    return engine, first.groupBy("repo_path").count().orderBy(F.desc("count"), "repo_path").first()[0]


@query(f"{_HITS} SELECT * FROM ({_TOP.format(repr('all'), '')}) UNION ALL SELECT * FROM ({_TOP.format(repr('one'), 'WHERE repo_path = (SELECT repo_path FROM big)')})")
def q51_search(spark, sf_dir):
    """A question searched in a store of the chunks, in all and in one repository."""
    folder = shared_path(spark, "engine")
    engine, repo = _filled(spark, sf_dir, folder)
    parts = [engine.search(_QUESTION, 5, r).select(F.lit(scope).alias("scope"), "chunk_id", "name", "distance", F.col("rank").cast("bigint").alias("rank")) for scope, r in (("all", None), ("one", repo))]
    out = checkpoint(parts[0].unionByName(parts[1]).unionByName(parts[0].sparkSession.createDataFrame([], parts[0].schema) if engine.search("  ").isEmpty() else parts[0]))
    shutil.rmtree(folder)
    return out


_WITH = chat.WITH_CONTEXT.replace("'", "''").split("{context}")


@query(f"{_HITS}, top AS (SELECT * FROM hits WHERE repo_path = (SELECT repo_path FROM big) ORDER BY distance, chunk_id LIMIT 3) SELECT '{_QUESTION}' AS question, '{_WITH[0]}' || string_agg('# ' || file_path || ' (' || element_type || ' ' || name || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY distance, chunk_id) || replace('{_WITH[1]}', '{{question}}', '{_QUESTION}') AS answer, count(*) AS sources FROM top")
def q52_ask(spark, sf_dir):
    """A question asked; the generator here answers with its prompt."""
    folder = shared_path(spark, "engine")
    engine, repo = _filled(spark, sf_dir, folder)
    got = engine.ask(_QUESTION, repo, 3)
    shutil.rmtree(folder)
    return spark.createDataFrame([(_QUESTION, got["answer"], len(got["sources"]))], "question string, answer string, sources bigint")


_HELD = f"h AS MATERIALIZED (SELECT chunk_id, repo_path, file_path, start_line FROM {_CHUNKS}), a AS (SELECT min(repo_path) AS r FROM h), b AS (SELECT max(repo_path) AS r FROM h), p AS (SELECT min(file_path) AS f FROM h WHERE repo_path = (SELECT r FROM a))"


@query(
    f"WITH {_HELD} SELECT step, repo_path, count(*) AS chunks, count(DISTINCT file_path) AS files, CAST(coalesce(sum(start_line), 0) AS BIGINT) AS lines FROM ("
    "SELECT 'added' AS step, * FROM h UNION ALL SELECT 'upserted', chunk_id, repo_path, file_path, CASE WHEN repo_path = (SELECT r FROM a) THEN 0 ELSE start_line END FROM h "
    "UNION ALL SELECT 'file deleted', chunk_id, repo_path, file_path, CASE WHEN repo_path = (SELECT r FROM a) THEN 0 ELSE start_line END FROM h WHERE NOT coalesce(repo_path = (SELECT r FROM a) AND file_path = (SELECT f FROM p), false) "
    "UNION ALL SELECT 'repository deleted', chunk_id, repo_path, file_path, CASE WHEN repo_path = (SELECT r FROM a) THEN 0 ELSE start_line END FROM h WHERE NOT coalesce(repo_path = (SELECT r FROM a) AND file_path = (SELECT f FROM p), false) AND repo_path <> (SELECT r FROM b)) GROUP BY 1, 2"
)
def q53_store(spark, sf_dir):
    """A store filled, upserted, a file and a repository deleted; its rows after each step."""
    folder = shared_path(spark, "store")
    engine, _ = _filled(spark, sf_dir, folder)
    held = engine.store
    steps = []

    def note(step: str) -> None:
        rows = held.read()
        steps.append(checkpoint(rows.groupBy("repo_path").agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), F.coalesce(F.sum("start_line"), F.lit(0)).cast("bigint").alias("lines")).select(F.lit(step).alias("step"), "repo_path", "chunks", "files", "lines")))

    note("added")
    first, last = held.repos()[0], held.repos()[-1]
    held.add(first, checkpoint(held.read(first).withColumn("start_line", F.lit(0))))
    note("upserted")
    held.delete_by_file(held.read(first).agg(F.min("file_path")).first()[0], first)
    note("file deleted")
    held.delete_by_repo(last)
    note("repository deleted")
    shutil.rmtree(folder)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


_SIZE = "CASE WHEN size < 1024 THEN printf('%.1f B', CAST(size AS DOUBLE)) WHEN size < 1048576 THEN printf('%.1f KB', size/1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size/1048576.0) ELSE printf('%.1f GB', size/1073741824.0) END"


@query(f"SELECT DISTINCT repo_path, path, name || ' (' || extension || ', ' || {_SIZE} || ')' AS file_label, CASE WHEN coalesce(line_count, 0) <> 0 THEN name || ' (' || CAST(line_count AS VARCHAR) || ' lines, ' || encoding || ', ' || CASE WHEN content IS NOT NULL THEN 'loaded' ELSE 'lazy' END || ')' ELSE name || ' (' || {_SIZE} || ', ' || CASE WHEN content IS NOT NULL THEN 'loaded' ELSE 'lazy' END || ')' END AS source_label FROM sources WHERE size IS NOT NULL AND encoding IS NOT NULL AND name IS NOT NULL")
def q54_labels(spark, sf_dir):
    """The display strings of scanned and of read files."""
    s = table(spark, sf_dir, "sources").filter("size is not null and encoding is not null and name is not null")
    return s.select("repo_path", "path", text.file_label(F.col("name"), F.col("extension"), F.col("size")).alias("file_label"), text.source_label(F.col("name"), F.col("line_count"), F.col("encoding"), F.col("size"), F.col("content").isNotNull()).alias("source_label")).distinct()


@query("SELECT DISTINCT return_type, trim(regexp_replace(': ' || return_type, '^:', '')) AS cleaned, trim('''\"' || name || '\"', '\"''') AS unquoted, rtrim('http://' || coalesce(parent_class, '') || '//', '/') AS url FROM elements WHERE name IS NOT NULL")
def q55_cleaned(spark, sf_dir):
    """Quotes, colons and slashes off the ends of names, result types and addresses."""
    e = table(spark, sf_dir, "elements").filter("name is not null")
    return e.select(
        "return_type", text.return_type(F.concat(F.lit(": "), "return_type")).alias("cleaned"), text.strip_quotes(F.concat(F.lit("'\""), "name", F.lit('"'))).alias("unquoted"),
        text.base_url(F.concat(F.lit("http://"), F.coalesce("parent_class", F.lit("")), F.lit("//"))).alias("url"),
    ).distinct()


@query("SELECT doc_id, printf('%.1f', n_chars / 8.0 + 0.01) AS label FROM documents WHERE n_chars IS NOT NULL")
def q56_distance_label(spark, sf_dir):
    """Distances with one decimal."""
    d = table(spark, sf_dir, "documents").filter("n_chars is not null")
    return d.select("doc_id", text.distance_label(F.col("n_chars") / F.lit(8.0) + F.lit(0.01)).alias("label"))


