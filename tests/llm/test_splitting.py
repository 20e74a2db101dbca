import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import splitting as S

KIND = "repo_path string, path string, type string, name string, start_line int, content string, piece int, length string"


def covered(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    done = 0
    for start, end, first, last in pieces:
        assert start <= done < end and end - start <= limit
        assert first == text.count("\n", 0, start) and last == text.count("\n", 0, end - 1)
        done = end
    assert done == len(text)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n{}():é\t,", min_size=1, max_size=600), st.integers(8, 90), st.integers(0, 4))
def test_pieces_cover_in_order(text, limit, overlap):
    covered(text, limit, overlap)


def test_natural_cuts_and_overlap():
    text = "".join(f"def f{i}(a):\n    x = a + {i}\n    y = x * 2\n    return y\n\n" for i in range(120))
    pieces = covered(text, 2000, 3)
    assert all(text[e - 1] == "\n" for _, e, _, _ in pieces)
    for (_, end, _, _), (start, _, _, _) in zip(pieces, pieces[1:]):
        assert text.count("\n", start, end) == 3 and text.startswith("def ", end)
    assert all(len(S.split_text("x" * n)) == -(-n // 2000) for n in (1999, 2000, 2001, 9000))
    assert covered("word " * 2000, 2000, 3)


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_ranges_give_the_same_pieces(spark):
    texts = ["".join(f"line {i} of a text, with words\n" for i in range(900)), "a b " * 4000, "é\n" * 3000 + "x" * 5000, "\n" * 5000]
    df = table(spark, [("r", f"{i}.py", "function", "f", 10, t, 1, "z") for i, t in enumerate(texts)])
    key = lambda rows: sorted((r.path, r.piece, r.pieces, r.piece_start, r.piece_end, r.content) for r in rows)
    whole = key(S.split_oversized(df).collect())
    for size in (2500, 7000):
        assert key(S.split_oversized(df, range_chars=size).collect()) == whole


def test_table(spark):
    big = "x = 1\n" * 500
    rows = [("r", "a.py", "class", "C", 5, big, 1, "z"), ("r", "a.py", "class", "C", 5, big, 1, "z"), ("r", "b.py", "import", "m", 1, "y" * 2001, 1, "z"), ("r", "c.py", "function", "f", 1, "y" * 2000, 1, "z"), (None, None, None, None, None, big, 1, "z"), ("r", "d.py", "function", "g", 1, None, 1, "z"), ("r", "e.py", "function", "h", 1, "😀" * 1500, 1, "z")]
    df = table(spark, rows)
    assert {(r.path, r.name) for r in S.oversized(df).collect()} == {("a.py", "C"), ("b.py", "m"), (None, None)}
    pieces = S.split_oversized(df.filter("path = 'a.py'").limit(1)).orderBy("piece").collect()
    assert pieces[0].piece_start == 5 and pieces[-1].piece_end == 504 and all(len(p.content) <= 2000 for p in pieces)
    chunks = S.piece_chunks(S.split_oversized(df.filter("path = 'a.py'"))).distinct().collect()
    assert len({c.chunk_id for c in chunks}) == len(chunks) == len(pieces) and chunks[0].name.startswith("C (part ")
    assert S.oversized(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\n", "a\r\nb\r\n"])
def test_tiny(text):
    if text:
        covered(text, 3, 3)


def test_files_by_byte_ranges(spark, tmp_path):
    texts = ["".join(f"line {i} of ünïcode 😀 text, with words\n" for i in range(900)), "a b " * 4000, "é\n" * 3000 + "x" * 5000, "short", "", "\n" * 5000, "😀" * 5000]
    rows = []
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_text(t, encoding="utf-8", newline="")
        rows.append(("r", f"{i}.txt", str(tmp_path / f"{i}.txt")))
    files = spark.createDataFrame([*rows, ("r", "gone", str(tmp_path / "gone")), ("r", None, None)], "repo_path string, path string, file string")
    df = table(spark, [("r", f"{i}.txt", "file", f"{i}.txt", 1, t, 1, "z") for i, t in enumerate(texts)])
    key = lambda rows: sorted((r.path, r.piece, r.pieces, r.piece_start, r.piece_end, r.content) for r in rows)
    want = key(S.split_oversized(df).collect())
    assert want
    for size in (1001, 1 << 20):
        assert key(S.split_files(files, range_bytes=size).collect()) == want


def test_read_range_gives_every_character_once(tmp_path):
    text = "aé😀\nb€" * 50
    (tmp_path / "t").write_text(text, encoding="utf-8", newline="")
    size = len(text.encode())
    for step in (1, 2, 3, 7, 64):
        parts = [S.read_range(str(tmp_path / "t"), lo, min(lo + step, size), 10) for lo in range(0, size, step)]
        assert "".join(p[1] for p in parts) == text
        at = 0
        for before, own, behind in parts:
            assert text[max(at - 10, 0) : at] == before and text[at + len(own) : at + len(own) + 10] == behind
            at += len(own)
