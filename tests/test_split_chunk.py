from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.operators import chunk, split
from corpuscle.operators.parse import parse_files


def test_segment_goldens():
    assert split.segments([4, 3, 5, 2, 20, 1], 10, 1, 3) == [(0, 2), (1, 3), (2, 4), (3, 5), (4, 6)]
    assert split.segments([9, 1], 10, 3, 3) == [(0, 0), (0, 1), (0, 2)]
    assert split.segments([12, 3, 4, 5], 10, 1, 0, False) == [(0, 1), (0, 2), (1, 3), (2, 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=40), st.integers(3, 20))
def test_segments_without_overlap_cover_all(costs, budget):
    got = [s for s in split.segments(costs, budget, 0, 0, False) if s[0] < s[1]]
    assert [i for a, b in got for i in range(a, b)] == list(range(len(costs)))


BODY = "def f(a):\n" + "".join(f"    x{i} = {i}\n" for i in range(400)) + "    return a"


def test_split_content_lines():
    exact = split.split_content(BODY, "function", 10, 411)
    compat = split.split_content(BODY, "function", 10, 411, line_mode="compat")
    assert len(exact) == len(compat) > 1 and exact[0][1] == compat[0][1] + 1 == 11
    assert all(t.startswith("def f(a):\n") for t, _, _ in exact)
    assert split.split_content(BODY, "class", 10, 411) == [(BODY, 10, 411)]
    long = "def f(" + ", ".join(f"a{i}" for i in range(600)) + "):\n    pass"
    assert [t for t, _, _ in split.split_content(long, "function", 1, 2)][0].startswith("def f(a0")


SOURCE = 'class C:\n    """First."""\n    def m(self):\n        return 1\n\nclass C:\n    """Second."""\n    def m(self):\n        return 2\n\nimport os\n'


def test_two_classes_of_one_name(spark):
    df = spark.createDataFrame([("/r", "a.py", SOURCE)], "repo_path string, path string, content string")
    built = chunk.build_chunks(parse_files(df))
    methods = built.filter("element_type = 'method'")
    assert methods.count() == 4
    kept = chunk.dedupe_chunks(built).filter("element_type = 'method'").collect()
    assert len(kept) == 2 and all("First." in r.content for r in kept)
    assert chunk.dedupe_chunks(built).filter("element_type = 'import'").count() == 0


def test_context_and_segments(spark):
    source = 'class Store(Base):\n    """Keeps rows."""\n\n    def size(self) -> int:\n        return 1\n\n' + BODY + "\n"
    df = spark.createDataFrame([("/r", "a.py", source)], "repo_path string, path string, content string")
    rows = {r.name: r for r in chunk.dedupe_chunks(chunk.build_chunks(parse_files(df))).collect()}
    assert rows["size"].content.startswith('# In class Store\nclass Store(Base):\n    """Keeps rows."""\n\ndef size(self) -> int:')
    parts = [r for n, r in rows.items() if n.startswith("f (part ")]
    assert len(parts) == parts[0].meta.split_total > 1 and len({r.chunk_id for r in parts}) == len(parts)


def test_keep_first_ties_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 5, "n"), (None, 4, None)], "k string, o int, row string")
    got = {(r.k, r.o, r.row) for r in chunk.keep_first(df, "k", "o", "row").collect()}
    assert got == {("a", 1, "y"), (None, 4, None)}
    assert {(r.k, r.dropped) for r in chunk.dropped_duplicates(df, "k").collect()} == {("a", 2), (None, 1)}
    assert chunk.keep_first(df.limit(0), "k", "o").count() == 0


def test_enrich(spark):
    source = "import os\nimport sys\n\nclass C:\n    '''Doc of C.'''\n    def m(self):\n        return 1\n"
    df = spark.createDataFrame([("/r", "a.py", source)], "repo_path string, path string, content string")
    elements = parse_files(df)
    plain = chunk.dedupe_chunks(chunk.build_chunks(elements, context=False))
    got = {r.name: r.content for r in chunk.enrich(plain, elements).collect()}
    assert got["m"] == "# File imports: os, sys\n# Class C docstring: Doc of C.\ndef m(self):\n        return 1"
    assert got["C"].startswith("# File imports: os, sys\nclass C:")


def test_ids_of_split_chunks_by_mode(spark):
    import hashlib

    from corpuscle.operators.chunk import build_chunks
    from corpuscle.operators.parse import ELEMENTS

    body = "def f(a):\n" + "".join(f"    x{i} = a + {i}\n" for i in range(20))
    e = spark.createDataFrame([("/r", "a.py", "python", 0, "function", "f", 5, 25, body, None, None, None, None, None)], ELEMENTS)
    for mode, field in (("exact", lambda r: 5), ("compat", lambda r: r.start_line)):
        got = build_chunks(e, budget=40, line_mode=mode).collect()
        assert len(got) > 2
        for r in got:
            raw = f"/r:a.py:f:function:{field(r)}:seg{r.meta.split_segment}"
            assert r.chunk_id == hashlib.md5(raw.encode()).hexdigest()[:12]
