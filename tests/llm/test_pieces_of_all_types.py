from corpuscle.llm.queries import QUERIES


def test_every_element_found_is_cut(spark, tmp_path):
    big = {t: f"{t} line of a long element\n" * 120 for t in ("class", "function", "method", "import", "interface", None)}
    rows = [("r", "a.py", t, f"n{i}", i, text) for i, (t, text) in enumerate(big.items())] + [("r", "a.py", "import", "small", 90, "import os")]
    spark.createDataFrame(rows, "repo_path string, path string, type string, name string, start_line int, content string").write.parquet(str(tmp_path / "elements.parquet"))
    found = {r.name for r in QUERIES["p2_found"](spark, str(tmp_path)).collect()}
    chunks = QUERIES["p2_pieces"](spark, str(tmp_path)).collect()
    assert len(found) == len(big) and {c.name.split(" (part ")[0] for c in chunks} == found
    assert {c.element_type for c in chunks} == set(big) and len({c.chunk_id for c in chunks}) == len(chunks)
    for t, text in big.items():
        lines = {n for c in chunks if c.element_type == t for n in range(c.start_line, c.end_line + 1)}
        assert len(lines) == text.count("\n")
