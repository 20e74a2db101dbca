import os

import pytest
from pyspark.sql import functions as F

from corpuscle.plans.engine import Engine
from corpuscle.sources import repo_files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for name, body in {"__init__.py": "", "_priv/m.py": "def priv():\n    return 1\n", ".github/w.yml": "a: 1\n", "a.py": "def read_file(path):\n    return open(path).read()\n", "B.PY": "def shout():\n    pass\n", "node_modules/x/i.js": "function i() {}", "build/out.py": "x = 1\n", "img.png": "x", ".py": "x", "sub/build": "no suffix"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return root


def test_scan_golden(spark, tree):
    got = [r.path for r in repo_files.scan(spark, str(tree)).orderBy("path").collect()]
    assert got == [".github/w.yml", "B.PY", "__init__.py", "_priv/m.py", "a.py"]
    flat = [r.path for r in repo_files.scan(spark, str(tree), recursive="false").orderBy("path").collect()]
    assert flat == ["B.PY", "__init__.py", "a.py"]
    times = {r.path: r.last_modified for r in repo_files.scan(spark, str(tree)).collect()}
    assert times["a.py"] == os.stat(tree / "a.py").st_mtime
    assert repo_files.scan(spark, str(tree), maxFileSize="10").filter("size > 10").count() == 0
    assert {r.path for r in repo_files.scan(spark, str(tree), ignore="_priv", extensions=".py").collect()} >= {"build/out.py", "a.py"}


def test_reader_checks(spark, tree):
    (tree / "bin.py").write_bytes(b"x\0y")
    (tree / "big.py").write_bytes(b"#" * (repo_files.READER_LIMIT + 1))
    rows = {r.path: r for r in repo_files.read_checked(spark, str(tree)).collect()}
    assert rows["bin.py"].error == "binary" and rows["big.py"].error and rows["big.py"].content is None
    assert rows["a.py"].error is None and rows["a.py"].line_count == 2 and rows["__init__.py"].line_count == 0


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFound|nope"):
        repo_files.scan(spark, str(tmp_path / "nope")).count()


def test_index_search_ask(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), generator=lambda p: f"<{len(p)}>")
    first = engine.index(str(tree))
    assert first["new"] == 4 and first["total_chunks"] == 3 and first["failed"] == 0
    again = engine.index(str(tree) + "/")
    # a file without chunks is never stored, so it is looked at on every run
    assert again["unchanged"] == 3 and again["new"] == 1 and again["total_chunks"] == 3
    hits = engine.search("read file", 2, str(tree)).orderBy("rank").collect()
    assert hits[0].name == "read_file" and len(hits) == 2
    assert engine.search("   ").count() == 0
    assert engine.search("read", repo_path=str(tmp_path / "other")).count() == 0
    answer = engine.ask("How are files read?", str(tree))
    assert answer["answer"].startswith("<") and len(answer["sources"]) == 3
    (tree / "a.py").write_text("def write_file(path):\n    pass\n")
    os.utime(tree / "a.py", (2e9, 2e9))
    (tree / "B.PY").unlink()
    third = engine.index(str(tree))
    assert third["changed"] == 1 and third["removed"] == 1 and third["total_chunks"] == 2
    names = {r.name for r in engine.store.read(str(tree)).select("name").collect()}
    assert names == {"write_file", "priv"}


def test_index_table(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    schema = "repo_path string, path string, last_modified double, content string, kind int"
    rows = [("/r", "a.py", 1.0, "def read_file(path):\n    return path\n", 1), ("/r/", "a.py", 1.0, "def read_file(path):\n    return path\n", 1), ("/s", "a.py", 1.0, "def shout():\n    pass\n", 1), ("/s", "b.js", 1.0, "function other() {}\n", 1), ("/s", "c.md", 1.0, "text", 1), (None, "a.py", 1.0, "def lost(): pass\n", 1), ("/s", "n.py", 1.0, None, 1)]
    first = engine.index_table(spark.createDataFrame(rows, schema))
    assert first["new"] == 4 and first["total_chunks"] == 3 and first["failed"] == 0
    assert engine.store.repos() == ["/r", "/s"] and engine.store.count("/s") == 2
    assert engine.search("read file", 1).collect()[0].name == "read_file"
    engine.index(str(tree))
    rows[2] = ("/s", "a.py", 2.0, "def whisper():\n    pass\n", 1)
    second = engine.index_table(spark.createDataFrame([rows[2]], schema))
    assert (second["changed"], second["removed"], second["total_chunks"]) == (1, 1, 5)
    assert {r.name for r in engine.store.read("/s").collect()} == {"whisper"} and engine.store.count("/r") == 1 and engine.store.count(str(tree)) == 3
    assert engine.index_table(spark.createDataFrame([rows[2]], schema))["unchanged"] == 1


def test_streaming_upsert(spark, tmp_path):
    from corpuscle.streaming.index import upsert_stream

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(([("a", 1), ("b", 1), ("b", 2)], [("b", 3), ("c", 1)])):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, v int").parquet(source)
        upsert_stream(stream, target, "k", str(tmp_path / "cp")).awaitTermination(60)
        got = {(r.k, r.v) for r in spark.read.parquet(f"{target}/v={i}").collect()}
    assert got == {("a", 1), ("b", 3), ("c", 1)}
    # another checkpoint folder: everything comes again and goes on from what is there
    (tmp_path / "out" / "v=2").mkdir()  # a version that was never finished
    upsert_stream(spark.readStream.schema("k string, v int").parquet(source), target, "k", str(tmp_path / "cp2")).awaitTermination(60)
    assert {(r.k, r.v) for r in spark.read.parquet(f"{target}/v=2").collect()} == {("a", 1), ("b", 3), ("c", 1)}


def test_windowed_versions(spark, tmp_path):
    from corpuscle.streaming.index import latest_versions

    source = str(tmp_path / "ev")
    spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:02:00"), ("b", "2024-01-01 00:12:00")], "key string, t string").select("key", F.col("t").cast("timestamp").alias("ts")).write.parquet(source)
    stream = latest_versions(spark.readStream.schema("key string, ts timestamp").parquet(source))
    stream.writeStream.format("memory").queryName("versions").outputMode("update").trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.key, r.events) for r in spark.table("versions").collect()} == {("a", 2), ("b", 1)}


def test_scan_spreads_below_one_directory(spark, tmp_path):
    for i in range(40):
        d = tmp_path / "src" / f"p{i}" / "deep"
        d.mkdir(parents=True)
        (d / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "top.py").write_text("")
    got = repo_files.scan(spark, str(tmp_path))
    assert sorted(r.path for r in got.collect()) == sorted([*(f"src/p{i}/deep/a.py" for i in range(40)), "src/top.py"])
    assert len(repo_files._Reader({"path": str(tmp_path)}).partitions()) > 2


def test_write_and_read_files(spark, tmp_path):
    rows = [("/r", "a/b.py", "x = 'é'\r\n", 5.0), ("/r", "gone.py", None, None), (None, "lost.py", "x", 1.0)]
    sources = spark.createDataFrame(rows, "repo_path string, path string, content string, last_modified double")
    assert repo_files.write_tree(sources, str(tmp_path)) == 2
    asked = spark.createDataFrame([("/r", "a/b.py"), ("/r", "gone.py"), ("/r", None)], "repo_path string, path string")
    got = {r.path: r for r in repo_files.read_files(asked, str(tmp_path)).collect()}
    assert got["a/b.py"].content == "x = 'é'\n" and got["a/b.py"].line_count == 1
    assert got["gone.py"].content is None and got["gone.py"].error and got[None].error == "no path"
    raw = repo_files.read_files(asked.limit(1), str(tmp_path), encoding="latin-1").collect()[0]
    assert raw.content == "x = 'Ã©'\n" and raw.encoding == "latin-1"


def test_shared_folder_needs_a_name_on_a_cluster():
    from types import SimpleNamespace

    from corpuscle.session import shared_folder

    conf = SimpleNamespace(get=lambda k, d=None: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))
