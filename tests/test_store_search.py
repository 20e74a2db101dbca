import numpy as np
import pytest

from corpuscle.operators import chat, diff, embed, search, stats, store


def vectors(spark, n=200, width=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)
    rows = [(i, f"r{i % 3}", [float(v) for v in x[i]]) for i in range(n)] + [(n, "r0", None), (n + 1, "r0", [1.0]), (n + 2, "r0", [])]
    return x, spark.createDataFrame(rows, "id bigint, repo_path string, vector array<float>")


@pytest.mark.parametrize("metric", search.METRICS)
def test_top_k_matches_brute_force(spark, metric):
    x, df = vectors(spark)
    q = [float(v) for v in x[7]]
    want = np.round(search.pairwise(x[7:8].astype(float), x.astype(float), metric)[0], 6)
    order = sorted(range(len(x)), key=lambda i: (want[i], i))[:5]
    got = search.top_k(df, q, 5, "id", metric=metric).orderBy("rank").collect()
    assert [r.id for r in got] == order and [r.rank for r in got] == [1, 2, 3, 4, 5]
    scoped = search.top_k(search.scoped(df, "r1"), q, 500, "id", metric=metric).collect()
    assert {r.repo_path for r in scoped} == {"r1"} and len(scoped) == 67
    assert search.top_k(df.limit(0), q, 5, "id").count() == 0


def test_batch_matches_single(spark):
    x, df = vectors(spark)
    many = search.top_k_of_many(df, df.filter("id % 50 = 0"), 4, "id")
    for qid in (0, 50, 150):
        single = [(r.id, r.rank) for r in search.top_k(df, [float(v) for v in x[qid]], 4, "id").orderBy("rank").collect()]
        assert single == sorted([(r.id, r.rank) for r in many.filter(f"query_id = {qid}").collect()], key=lambda p: p[1])


def test_ties_rank_by_key(spark):
    df = spark.createDataFrame([(k, "r", [1.0, 0.0]) for k in (5, 3, 9, 1)], "id bigint, repo_path string, vector array<float>")
    assert [r.id for r in search.top_k(df, [1.0, 0.0], 3, "id").orderBy("rank").collect()] == [1, 3, 5]
    with pytest.raises(ValueError):
        search.distance(df["vector"], [1.0], "l3")


def test_incremental_golden(spark):
    kind = "repo_path string, path string, last_modified double"
    indexed = spark.createDataFrame([("r", p, t) for p, t in (("a.py", 10.0), ("b.py", 20.0), ("c.py", 30.0), ("f.py", 40.0))] + [("s", "c.py", 1.0)], kind)
    current = spark.createDataFrame([("r", p, t) for p, t in (("a.py", 10.0), ("b.py", 21.0), ("d.md", 5.0), ("e.py", None), ("f.py", 39.0))] + [("s", "c.py", 1.0)], kind)
    got = {(r.repo_path, r.path): r.status for r in diff.classify(current, indexed).collect()}
    assert got == {("r", "a.py"): "unchanged", ("r", "b.py"): "changed", ("r", "c.py"): "removed", ("r", "d.md"): "new", ("r", "e.py"): "new", ("r", "f.py"): "unchanged", ("s", "c.py"): "unchanged"}
    assert diff.run_statistics(diff.classify(current, indexed)).first().asDict() == {"new": 2, "changed": 1, "unchanged": 3, "removed": 1}


def test_null_time_is_changed(spark):
    kind = "repo_path string, path string, last_modified double"
    a, b = spark.createDataFrame([("r", "e.py", None)], kind), spark.createDataFrame([("r", "e.py", 3.0)], kind)
    assert diff.classify(a, b).first().status == "changed"


def row(i, repo="/r", path="a.py", vector=None):
    meta = (None, ["x"], None, [], None, None, None, 1.0)
    return (i, repo, path, "python", "function", "f", 1, 2, "body", meta, vector or [1.0, 0.0], "e", None)


def test_store_life(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "store"))
    assert s.count() == 0 and s.repos() == []
    make = lambda rows: spark.createDataFrame(rows, store.STORE)
    assert s.add("/r", make([row("1"), row("2", path="b.py")])) == 2
    assert s.add("/r", make([row("2", path="b.py", vector=[0.0, 1.0]), row("3")])) == 3
    assert s.read("/r").filter("chunk_id = '2'").first().vector == [0.0, 1.0]
    s.add("/q", make([row("9", repo="/q")]))
    assert s.count() == 4 and s.count("/q/") == 1 and s.repos() == ["/q", "/r"]
    s.delete_by_file("a.py", "/r")
    assert s.count("/r") == 1 and s.count("/q") == 1
    s.delete_files("/r", ["b.py"])
    assert s.count("/r") == 0 and s.repos() == ["/q"]
    assert s.add("/q", make([])) == 1
    s.delete_by_repo("/q")
    assert s.count() == 0


def test_flatten_and_counts(spark):
    df = spark.createDataFrame([row("1")], store.STORE)
    flat = store.flatten(df).first()
    assert flat.parent_class is None and flat.last_modified == 1.0
    assert {(r.repo_path, r.chunks) for r in stats.store_counts(df).collect()} == {("/r", 1), (None, 1)}


def test_embedders(spark):
    e = embed.HashingEmbedder(16)
    v = embed.embed_query("read files from disk", e)
    assert len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-5 and v == embed.embed_query("read files from disk", e)
    with pytest.raises(RuntimeError):
        embed.embed_query("  ", e)
    df = spark.createDataFrame([("a", "x = 1"), ("b", None), ("c", "")], "k string, t string")
    got = {r.k: r.vector for r in embed.embed_column(df, "k", "t", e).collect()}
    assert got["a"] and got["b"] is None and got["c"] is None
    assert embed.HttpEmbedder("m", "http://127.0.0.1:9", timeout=0.2).embed(["x"]) == [None]


def test_prompts(spark):
    hits = [{"file_path": f"p{i}.py", "element_type": "function", "name": "f", "content": "body"} for i in (1, 2)]
    got = chat.build_prompt("Q?", hits)
    assert "# p1.py (function f)\nbody\n\n---\n\n# p2.py (function f)\nbody\n\nQuestion: Q?\nAnswer:" in got
    assert "No relevant code context" in chat.build_prompt("Q?", [])
    df = spark.createDataFrame([("g", i, h["file_path"], "function", "f", "body") for i, h in enumerate(hits)], "g string, rank int, file_path string, element_type string, name string, content string")
    folded = chat.fold_context(df, ["g"])
    from pyspark.sql import functions as F

    assert folded.select(chat.prompt(F.lit("Q?"), F.col("context"))).first()[0] == got
    assert chat.HttpGenerator("m", "http://127.0.0.1:9", 0.2)("x").startswith("Error generating answer")
