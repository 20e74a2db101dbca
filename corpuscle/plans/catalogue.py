"""Named queries over a data directory and the SQL each is checked against.

Every query runs over its whole tables. Those of the pipeline's steps (scanning to the engine) stand in
:mod:`corpuscle.plans.pipeline`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import lang, text
from corpuscle.functions.arrow import map_columns
from corpuscle.operators import chat, chunk, diff, embed, parse, search, split, stats, store
from corpuscle.plans import oracles
from corpuscle.plans.registry import ORACLE_SQL, QUERIES, query
from corpuscle.session import spread, table
from corpuscle.sources import repo_files

_VEC = "CAST({0}.embedding AS DOUBLE[])"
_FIRST = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


def _first_vector(vectors: DataFrame) -> list[float]:
    return list(vectors.orderBy("vec_id").select("vector").first()[0])


def _single(hits: DataFrame) -> DataFrame:
    return hits.select("vec_id", "label", "distance", F.col("rank").cast("bigint").alias("rank"))


def _topk_sql(distance: str, where: str = "") -> str:
    return f"SELECT vec_id, label, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT vec_id, label, round({distance}, 6) AS distance FROM embeddings e {where}) ORDER BY distance, vec_id LIMIT 5"


@query(_topk_sql(f"list_sum(list_transform(list_zip({_VEC.format('e')}, {_FIRST}), lambda p: (p[1]-p[2])*(p[1]-p[2])))", "WHERE label = 3"))
def q01_scoped_topk(spark, sf_dir):
    """Top five by squared distance within a scope."""
    v = _vectors(spark, sf_dir)
    own = search.scoped(v.withColumn("repo_path", F.col("label").cast("string")), "3")
    return _single(search.top_k(own, _first_vector(v), key="vec_id"))


@query(_topk_sql(f"list_sum(list_transform(list_zip({_VEC.format('e')}, {_FIRST}), lambda p: (p[1]-p[2])*(p[1]-p[2])))"))
def q02_global_topk(spark, sf_dir):
    """O3 without a scope."""
    v = _vectors(spark, sf_dir)
    return _single(search.top_k(v, _first_vector(v), key="vec_id"))


@query(_topk_sql(f"1 - list_dot_product({_VEC.format('e')}, {_FIRST}) / (sqrt(list_dot_product({_VEC.format('e')}, {_VEC.format('e')})) * sqrt(list_dot_product({_FIRST}, {_FIRST})))"))
def q03_cosine_topk(spark, sf_dir):
    """G6 by cosine distance."""
    v = _vectors(spark, sf_dir)
    return _single(search.top_k(v, _first_vector(v), key="vec_id", metric="cosine"))


@query(
    "SELECT query_vec_id, vec_id, distance, rank FROM (SELECT q.vec_id AS query_vec_id, e.vec_id, round(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: (p[1]-p[2])*(p[1]-p[2]))), 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: (p[1]-p[2])*(p[1]-p[2]))), 6), e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5"
)
def q04_batch_topk(spark, sf_dir):
    """J7 for a stated query set: every vector whose id is divisible by 50, against all."""
    v = _vectors(spark, sf_dir)
    near = search.top_k_of_many(spread(v), v.filter("vec_id % 50 = 0"), key="vec_id")
    return near.withColumn("distance", F.round(F.abs("distance"), 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "SELECT DISTINCT v.chunk_id, v.file_path, c.name, c.content, CAST(c.start_line AS BIGINT) AS start_line FROM vector_store v JOIN chunks c ON v.chunk_id = c.chunk_id WHERE v.vector IS NOT NULL"
)
def q05_hydrate_hits(spark, sf_dir):
    """Stored vectors with their chunks."""
    hits = table(spark, sf_dir, "vector_store").filter("vector is not null").select("chunk_id", "file_path")
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "name", "content", F.col("start_line").cast("bigint").alias("start_line"))
    return search.hydrate(hits.distinct(), chunks.distinct())


@query("SELECT lower(extension) AS extension, count(*) AS files FROM files GROUP BY 1 ORDER BY 1")
def q06_count_by_extension(spark, sf_dir):
    """A1, O2."""
    return stats.count_by_extension(table(spark, sf_dir, "files"))


@query("SELECT repo_path, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM files GROUP BY 1")
def q07_total_size(spark, sf_dir):
    """A2."""
    return stats.total_size(table(spark, sf_dir, "files"), "repo_path")


@query("SELECT repo_path, count(DISTINCT chunk_id) AS chunks FROM vector_store GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT chunk_id) FROM vector_store")
def q08_store_counts(spark, sf_dir):
    """A4: scoped and global."""
    return stats.store_counts(table(spark, sf_dir, "vector_store").filter("repo_path is not null"))


_IGNORED = ", ".join(f"'{d}'" for d in repo_files.IGNORED_DIRS)
_EXTENSIONS = ", ".join(f"'{e}'" for e in repo_files.EXTENSIONS)


@query(
    f"SELECT DISTINCT repo_path, path FROM files WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), [{_IGNORED}]) AND lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) IN ({_EXTENSIONS}) AND coalesce(size, 0) <= 10485760 ORDER BY 1, 2"
)
def q09_scan_filters(spark, sf_dir):
    """Ignored directories, extensions and size on a listing, in path order."""
    ignored, extensions = set(repo_files.IGNORED_DIRS), set(repo_files.EXTENSIONS)

    def run(repos: list, paths: list, sizes: list) -> dict[str, list]:
        kept = [(r, p) for r, p, n in zip(repos, paths, sizes) if repo_files.wanted_path(p, n, ignored, extensions, repo_files.READER_LIMIT)]
        return {"repo_path": [r for r, _ in kept], "path": [p for _, p in kept]}

    listed = map_columns(table(spark, sf_dir, "files"), ["repo_path", "path", "size"], run, "repo_path string, path string")
    return listed.distinct().orderBy("repo_path", "path")


@query("SELECT DISTINCT repo_path || '/' || path AS full_path, path AS relative_path FROM files")
def q10_paths(spark, sf_dir):
    """Paths resolved against their repository."""

    def run(repos: list, paths: list) -> dict[str, list]:
        return {"full_path": [None if r is None or p is None else repo_files.resolve_path(p, r) for r, p in zip(repos, paths)], "relative_path": paths}

    return map_columns(table(spark, sf_dir, "files"), ["repo_path", "path"], run, "full_path string, relative_path string").distinct()


@query(
    "SELECT DISTINCT repo_path, path, CAST(length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count FROM sources WHERE content IS NOT NULL"
)
def q11_line_count(spark, sf_dir):
    """T3."""
    return table(spark, sf_dir, "sources").filter("content is not null").select("repo_path", "path", text.line_count(F.col("content")).alias("line_count")).distinct()


@query(
    "SELECT DISTINCT size, CASE WHEN size < 1024 THEN printf('%.1f B', CAST(size AS DOUBLE)) WHEN size < 1048576 THEN printf('%.1f KB', size/1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size/1048576.0) ELSE printf('%.1f GB', size/1073741824.0) END AS label FROM files WHERE size IS NOT NULL"
)
def q12_size_label(spark, sf_dir):
    """T6."""
    return table(spark, sf_dir, "files").filter("size is not null").select("size", text.size_label(F.col("size")).alias("label")).distinct()


_LANG_SQL = "CASE lower(regexp_extract({0}, '[^/]+(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lang.LANGUAGES.items()) + " END"


@query(f"SELECT language, count(*) AS files, CAST(CASE WHEN language IN ('python', 'javascript', 'typescript', 'tsx') THEN count(*) ELSE 0 END AS BIGINT) AS parsed FROM (SELECT {_LANG_SQL.format('path')} AS language FROM (SELECT DISTINCT repo_path, path FROM files)) GROUP BY 1")
def q13_language(spark, sf_dir):
    """Files by language, and how many of them a parser takes."""
    files = table(spark, sf_dir, "files").select("repo_path", "path").distinct()
    every = lang.with_language(files).groupBy("language").agg(F.count("*").alias("files"))
    parsed = lang.parsable(files).groupBy("language").agg(F.count("*").alias("parsed"))
    return every.join(parsed, "language", "left").fillna(0, ["parsed"])


@query(
    "SELECT DISTINCT repo_path, path, name, CAST(start_line AS BIGINT) AS start_line, substring(md5(concat_ws(':', repo_path, path, name, type, nullif(parent_class, ''), CAST(start_line AS VARCHAR))), 1, 12) AS chunk_id FROM elements WHERE type <> 'import'"
)
def q14_chunk_ids(spark, sf_dir):
    """T12."""
    e = table(spark, sf_dir, "elements").filter("type <> 'import'")
    made = text.chunk_id(F.col("repo_path"), F.col("path"), F.col("name"), F.col("type"), F.col("parent_class"), F.col("start_line"))
    return e.select("repo_path", "path", "name", F.col("start_line").cast("bigint").alias("start_line"), made.alias("chunk_id")).distinct()


@query(
    "SELECT chunk_id, repo_path, file_path, name, CAST(start_line AS BIGINT) AS start_line, content FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY file_path NULLS FIRST, start_line NULLS FIRST, name NULLS FIRST, content NULLS FIRST) AS n FROM chunks) WHERE n = 1"
)
def q15_keep_first(spark, sf_dir):
    """D1 on the chunks as they are stored."""
    c = table(spark, sf_dir, "chunks").select("chunk_id", "repo_path", "file_path", "name", F.col("start_line").cast("bigint").alias("start_line"), "content")
    return chunk.keep_first(c, "chunk_id", "file_path", "start_line", "name", "content")


@query("SELECT chunk_id, count(*) - 1 AS dropped FROM chunks GROUP BY 1 HAVING count(*) > 1")
def q16_dropped_duplicates(spark, sf_dir):
    """What dedupe drops."""
    return chunk.dropped_duplicates(table(spark, sf_dir, "chunks").select("chunk_id"), "chunk_id")


@query("SELECT repo_path, file_path, max(last_modified) AS last_modified FROM vector_store WHERE file_path IS NOT NULL AND last_modified IS NOT NULL GROUP BY 1, 2")
def q17_indexed_files(spark, sf_dir):
    """A3, F12."""
    return stats.indexed_files(table(spark, sf_dir, "vector_store"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    current = table(spark, sf_dir, "files").select("repo_path", "path", "last_modified").filter("repo_path is not null and path is not null")
    indexed = table(spark, sf_dir, "vector_store").select("repo_path", F.col("file_path").alias("path"), "last_modified").filter("repo_path is not null and path is not null")
    return current, indexed


_CURRENT = "(SELECT repo_path, path, max(last_modified) AS current_time FROM files WHERE repo_path IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2)"
_INDEXED = "(SELECT repo_path, file_path AS path, max(last_modified) AS indexed_time FROM vector_store WHERE repo_path IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2)"
_STATUS = f"SELECT coalesce(c.repo_path, i.repo_path) AS repo_path, coalesce(c.path, i.path) AS path, c.current_time AS current_time, i.indexed_time AS indexed_time, CASE WHEN c.path IS NULL THEN 'removed' WHEN i.path IS NULL THEN 'new' WHEN i.indexed_time >= c.current_time THEN 'unchanged' ELSE 'changed' END AS status FROM {_CURRENT} c FULL JOIN {_INDEXED} i ON c.repo_path = i.repo_path AND c.path = i.path"


@query(f"SELECT 'new' AS side, repo_path, path FROM {_CURRENT} c WHERE NOT EXISTS (SELECT 1 FROM {_INDEXED} i WHERE i.repo_path = c.repo_path AND i.path = c.path) UNION ALL SELECT 'removed', repo_path, path FROM {_INDEXED} i WHERE NOT EXISTS (SELECT 1 FROM {_CURRENT} c WHERE i.repo_path = c.repo_path AND i.path = c.path)")
def q18_set_differences(spark, sf_dir):
    """J4, U2, U3 both ways."""
    current, indexed = _snapshots(spark, sf_dir)
    new = diff.removed(indexed, current).select(F.lit("new").alias("side"), "repo_path", "path")
    return new.unionByName(diff.removed(current, indexed).select(F.lit("removed").alias("side"), "repo_path", "path"))


@query(_STATUS)
def q19_classify(spark, sf_dir):
    """J3, F9."""
    return diff.classify(*_snapshots(spark, sf_dir))


@query(f"SELECT repo_path, {', '.join(f'count(*) FILTER (WHERE status = {s!r}) AS {s}' for s in ('new', 'changed', 'unchanged', 'removed'))} FROM ({_STATUS}) GROUP BY 1")
def q20_run_statistics(spark, sf_dir):
    """A5."""
    return diff.run_statistics(diff.classify(*_snapshots(spark, sf_dir)), "repo_path")


@query(
    "WITH n AS (SELECT chunk_id, max(start_line) AS line FROM chunks GROUP BY 1), o AS (SELECT chunk_id, max(last_modified) AS stored FROM vector_store GROUP BY 1) SELECT chunk_id, stored AS value FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.chunk_id = o.chunk_id) UNION ALL SELECT chunk_id, CAST(line AS DOUBLE) FROM n"
)
def q21_upsert(spark, sf_dir):
    """The store's rows with those of chunks in their place."""
    old = table(spark, sf_dir, "vector_store").groupBy("chunk_id").agg(F.max("last_modified").alias("value"))
    new = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.max("start_line").cast("double").alias("value"))
    return store.upsert(old, new)


@query(
    "WITH f AS (SELECT min(file_path) AS file_path FROM vector_store), r AS (SELECT min(v.repo_path) AS repo_path FROM vector_store v, f WHERE v.file_path = f.file_path) SELECT 'scoped' AS scope, repo_path, count(*) AS left_rows FROM vector_store WHERE NOT coalesce(file_path = (SELECT file_path FROM f) AND repo_path = (SELECT repo_path FROM r), false) GROUP BY 2 UNION ALL SELECT 'all', repo_path, count(*) FROM vector_store WHERE NOT coalesce(file_path = (SELECT file_path FROM f), false) GROUP BY 2"
)
def q22_delete_by_file(spark, sf_dir):
    """One file's rows out of one repository and out of all."""
    rows = table(spark, sf_dir, "vector_store").select("repo_path", "file_path")
    path = rows.agg(F.min("file_path")).first()[0]
    repo = rows.filter(search.conjunction(file_path=path)).agg(F.min("repo_path")).first()[0]
    out = [("scoped", store.delete_by_file(rows, path, repo)), ("all", store.delete_by_file(rows, path))]
    a, b = (left.groupBy("repo_path").agg(F.count("*").alias("left_rows")).select(F.lit(scope).alias("scope"), "repo_path", "left_rows") for scope, left in out)
    return a.unionByName(b)


@query("SELECT repo_path, count(*) AS left_rows FROM vector_store WHERE NOT coalesce(repo_path = (SELECT min(repo_path) FROM vector_store), false) GROUP BY 1")
def q23_delete_by_repo(spark, sf_dir):
    """W4."""
    rows = table(spark, sf_dir, "vector_store").select("repo_path")
    return store.delete_by_repo(rows, rows.agg(F.min("repo_path")).first()[0]).groupBy("repo_path").agg(F.count("*").alias("left_rows"))


@query(
    "SELECT DISTINCT chunk_id, content, file_path, element_type, name, language, start_line, end_line, nullif(repo_path, '') AS repo_path, nullif(meta.parent_class, '') AS parent_class, meta.last_modified AS last_modified FROM chunks"
)
def q24_flatten(spark, sf_dir):
    """The flat record of each chunk."""
    return store.flatten(table(spark, sf_dir, "chunks")).distinct()


@query(
    f"WITH RECURSIVE k AS MATERIALIZED (SELECT doc_id AS id, string_split(text, chr(10)) AS rows, list_transform(string_split(text, chr(10)), lambda x: {oracles.tokens('x')}) AS costs, 0 AS h, false AS ef FROM documents WHERE text IS NOT NULL), {oracles.folds(64, 2)} SELECT id AS doc_id, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS stop, md5(array_to_string(k.rows[a + 1:b], chr(10))) AS digest FROM f JOIN k USING (id)"
)
def q25_line_segments(spark, sf_dir):
    """K2, K6: greedy segments of 64 tokens of the documents' lines, two lines shared."""

    def run(ids: list, texts: list) -> dict[str, list]:
        rows = []
        for i, t in zip(ids, texts):
            lines = t.split("\n")
            rows += [(i, a, b, hashlib.md5("\n".join(lines[a:b]).encode()).hexdigest()) for a, b in split.segments([split.count_tokens(x) for x in lines], 64, 2, 0, False)]
        return {n: [r[j] for r in rows] for j, n in enumerate(("doc_id", "start", "stop", "digest"))}

    return map_columns(spread(table(spark, sf_dir, "documents").filter("text is not null")), ["doc_id", "text"], run, "doc_id bigint, start bigint, stop bigint, digest string")


@query(oracles.chunks(64) + " SELECT DISTINCT chunk_id, name FROM made")
def q26_part_names(spark, sf_dir):
    """Ids and display names of chunks cut to 64 tokens."""
    return chunk.dedupe_chunks(chunk.build_chunks(_elements(spark, sf_dir), budget=64)).select("chunk_id", "name")


_ELEMENTS = "(SELECT DISTINCT repo_path, path, language, seq, type, name, start_line, end_line, content, docstring, parent_class, parameters FROM elements)"


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "elements").distinct()


@query(oracles.chunks() + " SELECT element_type, count(*) AS n, count(DISTINCT file_path) AS paths FROM made GROUP BY 1")
def q27_union(spark, sf_dir):
    """Chunks of classes, methods and functions as one list, counted by type."""
    made = chunk.dedupe_chunks(chunk.build_chunks(_elements(spark, sf_dir)))
    return made.groupBy("element_type").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("paths"))


_PREFIX = "'# In class ' || c.name || chr(10) || 'class ' || c.name || CASE WHEN len(coalesce(c.parameters, [])) > 0 THEN '(' || array_to_string(c.parameters, ', ') || ')' ELSE '' END || ':' || CASE WHEN length(c.docstring) > 0 THEN chr(10) || '    \"\"\"' || c.docstring || '\"\"\"' ELSE '' END || chr(10) || chr(10)"
_PAIRS = f"{_ELEMENTS} m JOIN {_ELEMENTS} c ON m.repo_path = c.repo_path AND m.path = c.path AND m.parent_class = c.name AND c.type = 'class' AND m.type = 'method'"


@query(f"SELECT DISTINCT m.repo_path, m.path, m.name, CAST(m.start_line AS BIGINT) AS start_line, {_PREFIX} || m.content AS content FROM {_PAIRS}")
def q28_class_context(spark, sf_dir):
    """Methods with the lines that name their class."""
    rows = chunk.methods_with_classes(table(spark, sf_dir, "elements"))
    full = F.concat(chunk.class_context(F.col("parent_class"), F.col("bases"), F.col("class_docstring")), F.col("content"))
    return rows.select("repo_path", "path", "name", F.col("start_line").cast("bigint").alias("start_line"), full.alias("content")).distinct()


@query(f"SELECT m.repo_path, m.path, m.parent_class, count(*) AS pairs FROM {_PAIRS} GROUP BY 1, 2, 3")
def q29_methods_with_classes(spark, sf_dir):
    """Many to many by class name within a file."""
    e = table(spark, sf_dir, "elements").select("repo_path", "path", "language", "seq", "type", "name", "start_line", "end_line", "content", "docstring", "parent_class", "parameters").distinct()
    return chunk.methods_with_classes(e).groupBy("repo_path", "path", "parent_class").agg(F.count("*").alias("pairs"))


_IMPORTS = "(SELECT repo_path, path, list(name ORDER BY seq, name) AS names FROM (SELECT DISTINCT repo_path, path, seq, name FROM elements WHERE type = 'import') GROUP BY 1, 2)"
_SUMMARY = "array_to_string(list_slice(names, 1, 5), ', ') || CASE WHEN len(names) > 5 THEN ', ... (' || CAST(len(names) - 5 AS VARCHAR) || ' more)' ELSE '' END"


def _distinct_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "elements").filter("type = 'import'").select("repo_path", "path", "type", "seq", "name").distinct()


@query(
    f"WITH i AS {_IMPORTS}, k AS (SELECT repo_path, path, name, docstring FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, path, name ORDER BY seq, start_line, content) AS n FROM {_ELEMENTS} WHERE type = 'class') WHERE n = 1), d AS (SELECT DISTINCT chunk_id, repo_path, file_path, element_type, name, content, nullif(meta.parent_class, '') AS parent FROM chunks) "
    f"SELECT DISTINCT d.chunk_id, concat_ws(chr(10), CASE WHEN len(i.names) > 0 THEN '# File imports: ' || {_SUMMARY} END, CASE WHEN length(k.docstring) > 0 AND NOT contains(d.content, k.docstring) THEN '# Class ' || d.parent || ' docstring: ' || k.docstring END, d.content) AS content FROM d LEFT JOIN i ON i.repo_path = d.repo_path AND i.path = d.file_path LEFT JOIN k ON d.element_type = 'method' AND k.repo_path = d.repo_path AND k.path = d.file_path AND k.name = d.parent"
)
def q30_enrich(spark, sf_dir):
    """Chunks with imports and missing class docstrings."""
    imports = _distinct_imports(spark, sf_dir)
    classes = table(spark, sf_dir, "elements").filter("type = 'class'").select("repo_path", "path", "language", "seq", "type", "name", "start_line", "end_line", "content", "docstring", "parent_class", "parameters").distinct()
    both = classes.unionByName(imports, allowMissingColumns=True)
    return chunk.enrich(table(spark, sf_dir, "chunks"), both).select("chunk_id", "content").distinct()


@query(f"SELECT repo_path, path AS file_path, {_SUMMARY} AS summary FROM {_IMPORTS}")
def q31_import_summary(spark, sf_dir):
    """K14, O4."""
    return chunk.file_imports(_distinct_imports(spark, sf_dir)).select("repo_path", "file_path", chunk.import_summary(F.col("imports")).alias("summary"))


@query("SELECT DISTINCT chunk_id, concat_ws(':', file_path, CAST(start_line AS VARCHAR)) AS label, substring(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), 1, 400) AS snippet FROM chunks")
def q32_snippets(spark, sf_dir):
    """T13, T14."""
    return table(spark, sf_dir, "chunks").select("chunk_id", text.reference_label(F.col("file_path"), F.col("start_line")).alias("label"), text.snippet(F.col("content")).alias("snippet")).distinct()


_FIRST_FIVE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT chunk_id, repo_path, file_path, element_type, name, content FROM chunks WHERE repo_path IS NOT NULL AND file_path IS NOT NULL AND element_type IS NOT NULL AND name IS NOT NULL AND content IS NOT NULL)) WHERE rank <= 5)"
_WITH = chat.WITH_CONTEXT.replace("'", "''").split("{context}")


@query(
    f"SELECT repo_path, '{_WITH[0]}' || string_agg('# ' || file_path || ' (' || element_type || ' ' || name || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || '{_WITH[1].replace('{question}', 'What does this repository do?')}' AS prompt FROM {_FIRST_FIVE} GROUP BY 1"
)
def q33_prompts(spark, sf_dir):
    """One prompt a repository from its first five chunks."""
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "repo_path", "file_path", "element_type", "name", "content").dropna().distinct()
    first = F.slice(F.array_sort(F.collect_list(F.struct("chunk_id", "file_path", "element_type", "name", "content"))), 1, 5)
    # five rows of each repository and part before the groups meet, so that no group is gathered whole
    parts = rows.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).groupBy("repo_path", "part").agg(first.alias("h"))
    hits = parts.groupBy("repo_path").agg(F.slice(F.array_sort(F.flatten(F.collect_list("h"))), 1, 5).alias("h")).select("repo_path", F.posexplode("h").alias("rank", "c")).select("repo_path", "rank", "c.*")
    return chat.fold_context(hits, ["repo_path"]).select("repo_path", chat.prompt(F.lit("What does this repository do?"), F.col("context")).alias("prompt"))


_WITHOUT = chat.NO_CONTEXT.replace("'", "''").split("{question}")


@query(f"SELECT item_id, '{_WITHOUT[0]}' || text || '{_WITHOUT[1]}' AS prompt FROM eval_items WHERE text IS NOT NULL")
def q34_prompts_without_context(spark, sf_dir):
    """The template for no hits."""
    items = table(spark, sf_dir, "eval_items").filter("text is not null")
    return items.select("item_id", chat.prompt(F.col("text"), F.lit(None).cast("string")).alias("prompt"))


@query(f"SELECT doc_id, CAST({oracles.tokens('text')} AS BIGINT) AS tokens, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^ \\t\\n\\x0b\\f\\rA-Za-z0-9_]')) AS BIGINT) AS native_tokens FROM documents WHERE text IS NOT NULL")
def q35_token_count(spark, sf_dir):
    """K2, K3: the splitter's token counter, and the column that counts in the JVM (with ASCII white space)."""

    def run(ids: list, texts: list, native: list) -> dict[str, list]:
        return {"doc_id": ids, "tokens": [split.count_tokens(t) for t in texts], "native_tokens": native}

    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", text.token_count(F.col("text")).cast("bigint").alias("native"))
    return map_columns(rows, ["doc_id", "text", "native"], run, "doc_id bigint, tokens bigint, native_tokens bigint")


@query("SELECT DISTINCT repo_path, path, md5(regexp_replace(content, '\\r\\n?', chr(10), 'g')) AS digest FROM sources WHERE content IS NOT NULL")
def q36_newlines(spark, sf_dir):
    """Line ends made one."""
    return table(spark, sf_dir, "sources").filter("content is not null").select("repo_path", "path", F.md5(text.normalise_newlines(F.col("content"))).alias("digest")).distinct()


@query(
    "SELECT DISTINCT name, extension, CAST(floor(coalesce(last_modified, 0)) AS BIGINT) % 200000 AS age, CASE WHEN CAST(floor(coalesce(last_modified, 0)) AS BIGINT) % 200000 < 60 THEN 'just now' WHEN CAST(floor(coalesce(last_modified, 0)) AS BIGINT) % 200000 < 3600 THEN CAST((CAST(floor(coalesce(last_modified, 0)) AS BIGINT) % 200000) // 60 AS VARCHAR) || 'm ago' ELSE CAST((CAST(floor(coalesce(last_modified, 0)) AS BIGINT) % 200000) // 3600 AS VARCHAR) || 'h ago' END AS seen, lpad(CAST(coalesce(size, 0) % 900 AS VARCHAR), 3, '0') AS padded, CASE WHEN coalesce(size, 0) % 3 = 1 THEN 'entry' ELSE 'entries' END AS word FROM files"
)
def q37_display(spark, sf_dir):
    """Relative times, padded numbers and headings."""
    age = F.floor(F.coalesce("last_modified", F.lit(0.0))).cast("bigint") % 200000
    size = F.coalesce("size", F.lit(0))
    return table(spark, sf_dir, "files").select("name", "extension", age.alias("age"), text.relative_time(age).alias("seen"), text.zero_pad(size % 900).alias("padded"), text.plural(size % 3).alias("word")).distinct()


@query("SELECT CAST(count(*) FILTER (WHERE error IS NULL AND content IS NOT NULL) AS BIGINT) AS \"read\", CAST(count(*) FILTER (WHERE NOT (error IS NULL AND content IS NOT NULL)) AS BIGINT) AS failed, CAST(coalesce(sum(line_count) FILTER (WHERE error IS NULL AND content IS NOT NULL), 0) AS BIGINT) AS lines, CAST(coalesce(sum(size) FILTER (WHERE error IS NULL AND content IS NOT NULL), 0) AS BIGINT) AS bytes FROM sources")
def q38_batch_totals(spark, sf_dir):
    """What a batch read gave."""
    return stats.batch_totals(table(spark, sf_dir, "sources"))


@query("SELECT repo_path, path, count(*) AS elements, count(*) FILTER (WHERE type = 'import') AS imports, count(*) FILTER (WHERE type = 'class') AS classes, count(*) FILTER (WHERE type = 'function') AS functions, count(*) FILTER (WHERE type = 'method') AS methods FROM (SELECT DISTINCT * FROM elements) GROUP BY 1, 2")
def q39_categories(spark, sf_dir):
    """Elements of each file by type."""
    files = parse.parsed_files(_elements(spark, sf_dir).withColumn("language", F.lit("any")))
    return files.select("repo_path", F.col("file_path").alias("path"), *(F.size(c).cast("bigint").alias(c) for c in ("elements", "imports", "classes", "functions", "methods")))


@query("SELECT 'embedded' AS gate, count(*) AS n FROM vector_store WHERE vector IS NOT NULL UNION ALL SELECT 'timed', count(*) FROM (SELECT DISTINCT repo_path, file_path FROM vector_store WHERE file_path IS NOT NULL AND last_modified IS NOT NULL) UNION ALL SELECT 'typed', count(*) FROM documents WHERE length(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', '', 'g')) > 0")
def q40_null_gates(spark, sf_dir):
    """What the gates on vectors, times and typed texts let through."""
    v = table(spark, sf_dir, "vector_store")
    gates = [("embedded", embed.embedded(v)), ("timed", stats.indexed_files(v)), ("typed", table(spark, sf_dir, "documents").filter(text.nonblank(F.col("text"))))]
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("gate"), "n") for name, rows in gates]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT DISTINCT repo_path, path, array_to_string(list_slice(string_split(content, chr(10)), 1, 10), chr(10)) AS preview FROM sources WHERE content IS NOT NULL")
def q41_preview(spark, sf_dir):
    """The first ten lines."""
    return table(spark, sf_dir, "sources").filter("content is not null").select("repo_path", "path", text.preview(F.col("content")).alias("preview")).distinct()


from corpuscle.plans import pipeline  # noqa: E402, F401 - registers the queries of the pipeline

__all__ = ["ORACLE_SQL", "QUERIES"]
