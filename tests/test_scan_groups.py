import os

import pytest

from corpuscle.plans import pipeline
from corpuscle.plans.registry import ORACLE_SQL
from corpuscle.sources import repo_files

DATA = "/root/testdata/sf0.001"


def test_small_roots_share_partitions(spark, tmp_path):
    for i in range(60):
        for d in ("a", "b/c", "node_modules"):
            (tmp_path / f"r{i}" / d).mkdir(parents=True)
            (tmp_path / f"r{i}" / d / "x.py").write_text(f"x = {i}\n")
    roots = [str(tmp_path / f"r{i}") for i in range(60)]
    parts = repo_files._Reader({"path": "\n".join(roots), "tasks": "6"}).partitions()
    assert len(parts) == 6
    got = repo_files.scan(spark, roots, content=True)
    assert got.rdd.getNumPartitions() <= 16
    assert sorted((r.repo_path, r.path, r.content) for r in got.collect()) == sorted((r, p, f"x = {i}\n") for i, r in enumerate(roots) for p in ("a/x.py", "b/c/x.py"))
    assert repo_files.scan(spark, roots, recursive="false").count() == 0
    repo_files.remove_trees(spark, roots)
    assert os.listdir(tmp_path) == []


def test_long_batches(spark, tmp_path, monkeypatch):
    for i in range(7):
        (tmp_path / f"{i}.py").write_text("é" * i)
    monkeypatch.setattr(repo_files, "BATCH_ROWS", 3)
    reader = repo_files._Reader({"path": str(tmp_path), "content": "true"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in batches] == [3, 3, 1]
    assert [(r["path"], r["size"], r["content"]) for b in batches for r in b.to_pylist()] == [(f"{i}.py", 2 * i, "é" * i) for i in range(7)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_repositories_stand_on_disk_in_groups(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(pipeline, "GROUP_FILES", 10)
    standing = []
    removed = repo_files.remove_trees
    monkeypatch.setattr(repo_files, "remove_trees", lambda spark, roots: (standing.append(len(roots)), removed(spark, roots)))
    got = pipeline.q45_repo_scan(spark, DATA)
    want = duckdb.execute(ORACLE_SQL["q45_repo_scan"].replace("FROM sources", f"FROM '{DATA}/sources.parquet'")).fetchall()
    assert len(standing) > 1 and max(standing) < sum(standing)
    columns = ["mode", "repo_path", "path", "name", "extension", "size", "modified", "encoding", "line_count", "digest", "error"]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))
