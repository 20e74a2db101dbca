"""The ``repo_files`` data source: walk directory trees and, if asked, read and decode the files.

Spark's own file sources drop names that begin with ``_`` or ``.`` and truncate modification times,
so trees are walked here. Options (all strings): ``path`` (one root, or several separated by a line
break), ``recursive`` (true), ``ignore`` and ``extensions`` (comma-separated; empty means the
defaults), ``maxFileSize`` (bytes; 0: none), ``content`` (false), ``readerLimit`` (bytes a file may
have to be read; 0: none), ``rejectBinary`` (false), ``tasks`` (most partitions; by default four a core).
Directories are listed level by level until a root has enough of them to be dealt out, so a tree with
all its code under one directory is walked in parallel too, while many small roots share partitions;
the paths must be visible to the executors.
"""

from __future__ import annotations

import os
import shutil
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuscle.functions.arrow import map_columns
from corpuscle.functions.text import decode_bytes, line_count_of
from corpuscle.session import ship_package

#: Directories never entered, and file name extensions that are read.
IGNORED_DIRS = ".git node_modules __pycache__ venv .venv dist build .idea .vscode coverage .pytest_cache .mypy_cache .tox eggs .eggs site-packages".split()
EXTENSIONS = ".py .js .jsx .ts .tsx .java .cpp .c .h .hpp .go .rs .rb .php .swift .kt .scala .cs .vb .sql .sh .bash .zsh .yaml .yml .json .xml .toml .ini .cfg .md .rst .txt .html .css .scss .sass".split()
#: Most bytes that the checking reader takes, and how many of them the binary test looks at.
READER_LIMIT, BINARY_SAMPLE = 10 * 1024 * 1024, 1024

FILES = "repo_path string, path string, name string, extension string, size bigint, last_modified double"
SOURCES = FILES + ", content string, encoding string, line_count bigint, error string"


#: Directories of all roots and of each root from which a listing is dealt out: no level below is listed on the driver. Plain files of so many directories make a partition.
ENOUGH_DIRECTORIES, ENOUGH_OF_ROOT, FLAT_DIRECTORIES = 256, 16, 32
#: Rows and characters that a batch has at least, once full.
BATCH_ROWS, BATCH_CHARS = 4096, 4 << 20


class _Part(InputPartition):
    """(root, directory, whether with all below) of any roots."""

    def __init__(self, folders: list[tuple[str, str, bool]]):
        self.folders = folders


def extension_of(name: str) -> str:
    """the suffix of a file name, in lower case; a name that only begins with a dot has none."""
    return os.path.splitext(name)[1].lower()


def wanted_file(name: str, size: int, extensions: set[str], largest: int = 0) -> bool:
    """whether a file of this name and size is kept; ``largest`` 0 sets no limit."""
    return extension_of(name) in extensions and not (largest and size > largest)


def wanted_path(path: str | None, size: int | None, ignored: set[str], extensions: set[str], largest: int = 0) -> bool:
    """F1-F3 on a listed path: no ignored directory above the file, a wanted suffix, not too large."""
    if path is None:
        return False
    *folders, name = path.split("/")
    return not ignored.intersection(folders) and wanted_file(name, size or 0, extensions, largest)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.path.abspath(p) for p in options.get("path", "").split("\n") if p]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.ignored = {x for x in options.get("ignore", "").split(",") if x} or set(IGNORED_DIRS)
        self.extensions = {x.lower() for x in options.get("extensions", "").split(",") if x} or set(EXTENSIONS)
        self.largest = int(options.get("maxfilesize", options.get("maxFileSize", "0")) or 0)
        self.content = options.get("content", "false").lower() == "true"
        self.limit = int(options.get("readerlimit", options.get("readerLimit", "0")) or 0)
        self.binary = options.get("rejectbinary", options.get("rejectBinary", "false")).lower() == "true"
        self.tasks = int(options.get("tasks", "0") or 0) or ENOUGH_DIRECTORIES

    def partitions(self) -> list[InputPartition]:
        flat: list[tuple[str, str, bool]] = []
        deep: list[tuple[str, str, bool]] = []
        enough = max(ENOUGH_DIRECTORIES // max(len(self.roots), 1), ENOUGH_OF_ROOT)
        for root in self.roots:
            if not os.path.exists(root):
                raise FileNotFoundError(root)
            if not os.path.isdir(root):
                raise NotADirectoryError(root)
            level = [root]
            while level and self.recursive and len(level) < enough:
                flat += [(root, d, False) for d in level]
                level = [d for folder in level for d in self._inside(folder)]
            (deep if self.recursive else flat).extend((root, d, self.recursive) for d in level)
        # dealt in turn, so neighbours of a large root go to different partitions
        parts = min(self.tasks, len(deep) + -(-len(flat) // FLAT_DIRECTORIES))
        return [_Part((deep + flat)[i::parts]) for i in range(parts)]

    def _inside(self, folder: str) -> list[str]:
        try:
            return sorted(d.path for d in os.scandir(folder) if d.is_dir(follow_symlinks=False) and d.name not in self.ignored)
        except OSError:
            return []

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        kind = _arrow(SOURCES if self.content else FILES)
        rows: list[tuple] = []
        chars = 0
        for root, top, deep in partition.folders:
            for folder, names in self._walk(top) if deep else self._own(top):
                inside = os.path.relpath(folder, root).replace(os.sep, "/")
                inside = "" if inside == "." else inside + "/"
                for name in sorted(names):
                    row = self._row(root, folder, inside, name)
                    if row is None:
                        continue
                    rows.append(row)
                    chars += len(row[6] or "") if self.content else 0
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield _batch(rows, kind)
                        rows, chars = [], 0
        if rows:
            yield _batch(rows, kind)

    def _own(self, folder: str) -> Iterator[tuple[str, list[str]]]:
        try:
            yield folder, [d.name for d in os.scandir(folder) if not d.is_dir(follow_symlinks=False)]
        except OSError:
            return

    def _walk(self, top: str) -> Iterator[tuple[str, list[str]]]:
        for folder, dirs, names in os.walk(top):
            dirs[:] = sorted(d for d in dirs if d not in self.ignored)
            yield folder, names

    def _row(self, root: str, folder: str, inside: str, name: str) -> tuple | None:
        extension = extension_of(name)
        if extension not in self.extensions:
            return None
        full = os.path.join(folder, name)
        try:
            found = os.stat(full)
        except OSError:
            return None
        if not stat.S_ISREG(found.st_mode) or not wanted_file(name, found.st_size, self.extensions, self.largest):
            return None
        row = (root, inside + name, name, extension, found.st_size, found.st_mtime)
        return row + read_file(full, self.limit, self.binary) if self.content else row


def _arrow(schema: str) -> pa.Schema:
    """A schema of strings and numbers as Arrow's; readers have no session that could parse it."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def read_file(full: str, limit: int = 0, reject_binary: bool = False, encoding: str | None = None) -> tuple[str | None, str | None, int | None, str | None]:
    """(content, encoding, line_count, error) of one file; one that can't be read has null content and its error."""
    try:
        if limit and os.path.getsize(full) > limit:
            return (None, None, None, f"larger than {limit} bytes")
        with open(full, "rb") as f:
            data = f.read()
    except OSError as e:
        return (None, None, None, str(e))
    if reject_binary and b"\0" in data[:BINARY_SAMPLE]:
        return (None, None, None, "binary")
    text, used = decode_bytes(data, encoding)
    return (text, used, line_count_of(text), None)


class RepoFiles(DataSource):
    """Registered as ``repo_files``."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SOURCES if self.options.get("content", "false").lower() == "true" else FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def normalise_root(path: str) -> str:
    """The absolute form under which a repository is known, on write and on read alike."""
    return os.path.abspath(path)


def scan(spark: SparkSession, path: str | list[str], *, content: bool = False, **options: str) -> DataFrame:
    """Files of a repository or of several (F1-F4 applied), one row each; sort by ``path`` for the walk's order.

    An empty directory gives an empty table; a missing path or a file raises as the listing is planned.
    """
    ship_package(spark)
    spark.dataSource.register(RepoFiles)
    roots = [path] if isinstance(path, str) else path
    reader = spark.read.format("repo_files").option("path", "\n".join(map(normalise_root, roots))).option("content", str(content).lower()).option("tasks", str(4 * spark.sparkContext.defaultParallelism))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`scan` with contents, but files over the reader's limit or binary ones have an error instead."""
    return scan(spark, path, content=True, readerLimit=str(READER_LIMIT), rejectBinary="true")


def resolve_path(file_path: str, base_path: str | None = None) -> str:
    """An absolute path stays; a relative one is taken from the base, else from the working directory."""
    if os.path.isabs(file_path):
        return file_path
    return os.path.join(base_path, file_path) if base_path else os.path.abspath(file_path)


_READ = "repo_path string, path string, content string, encoding string, line_count bigint, error string"


def read_files(files: DataFrame, base_path: str | None = None, encoding: str | None = None, limit: int = READER_LIMIT, reject_binary: bool = True) -> DataFrame:
    """The files of a table of paths (repo_path, path), read where the rows lie; ``error`` says which failed.

    A relative path is taken from ``base_path`` and its repo_path. With ``encoding`` files are decoded
    by it first. Rows with a null path have that as their error; repeated rows are read again. Rows of
    a scan's result serve as well, so metadata can be filtered before anything is read.
    """

    def run(repos: list, paths: list) -> dict[str, list]:
        got = [(None, None, None, "no path") if p is None else read_file(resolve_path(p, resolve_path(r.lstrip("/") if base_path else r, base_path) if r else base_path), limit, reject_binary, encoding) for r, p in zip(repos, paths)]
        columns = dict(zip(("content", "encoding", "line_count", "error"), map(list, zip(*got)))) if got else dict.fromkeys(("content", "encoding", "line_count", "error"), [])
        return {"repo_path": repos, "path": paths, **columns}

    return map_columns(files, ["repo_path", "path"], run, _READ)


def write_tree(sources: DataFrame, folder: str) -> int:
    """A sink: write (repo_path, path, content, last_modified) as files under a folder that all executors share.

    A null content leaves a link to nowhere, a file that can't be read. Each file must have one row;
    a task that runs again writes the same. Rows of neighbouring directories should lie in one partition:
    tasks that create names in one directory wait for each other. Returns the number of files.
    """

    def run(repos: list, paths: list, contents: list, times: list) -> dict[str, list]:
        made: set[str] = set()
        for i in sorted(range(len(paths)), key=lambda i: (repos[i], paths[i])):
            repo, path, content, time = repos[i], paths[i], contents[i], times[i]
            full = os.path.join(folder, repo.lstrip("/"), path)
            above = os.path.dirname(full)
            if above not in made:
                os.makedirs(above, exist_ok=True)
                made.add(above)
            if content is None:
                if not os.path.islink(full):
                    os.symlink("nowhere", full)
                continue
            staged = f"{full}.{os.getpid()}~"
            with open(staged, "wb") as f:
                f.write(content.encode())
            os.utime(staged, (time or 0, time or 0))
            os.replace(staged, full)
        return {"files": [len(paths)] if paths else []}

    columns = ["repo_path", "path", "content", "last_modified"]
    return map_columns(sources.dropna(subset=["repo_path", "path"]), columns, run, "files bigint").groupBy().sum("files").first()[0] or 0


def remove_trees(spark: SparkSession, roots: list[str]) -> None:
    """Remove trees in a folder that all executors share, in tasks."""
    ship_package(spark)
    tasks = min(len(roots), 2 * spark.sparkContext.defaultParallelism)
    spark.sparkContext.parallelize(roots, max(tasks, 1)).foreach(lambda root: shutil.rmtree(root, ignore_errors=True))
