import pytest
from pyspark.sql import functions as F

from corpuscle.functions import lang, text


def column(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(("data", "want", "lines"), [(b"x\r\ny\r", "x\ny\n", 2), (b"", "", 0), (b"a", "a", 1), (b"a\n", "a\n", 1), (b"caf\xe9", "café", 1), ("é".encode("utf-16"), "é", 1), (b"\xef\xbb\xbfa", "a", 1)])
def test_decode_ladder(data, want, lines):
    got, _ = text.decode_bytes(data)
    assert got == want and text.line_count_of(got) == lines


@pytest.mark.parametrize(("value", "want"), [("", 0), ("a", 1), ("a\n", 1), ("a\n\nb", 3), (None, None)])
def test_line_count(spark, value, want):
    assert column(spark, value, text.line_count) == want


@pytest.mark.parametrize(("size", "want"), [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1536, "1.5 KB"), (5 * 1024**3, "5.0 GB"), (3 * 1024**4, "3.0 TB"), (None, None)])
def test_size_label(spark, size, want):
    assert column(spark, size, text.size_label, "bigint") == want


def test_chunk_id(spark):
    row = spark.createDataFrame([("/r", "a.py", "f", "function", "", 3)], "r string, p string, n string, t string, c string, l int")
    args = [F.col(c) for c in "rpntcl"]
    assert row.select(text.chunk_id(*args)).first()[0] == "9eda2a0487ca"
    assert row.select(text.chunk_id(*args, F.lit(None).cast("int"))).first()[0] == "9eda2a0487ca"
    assert row.select(text.chunk_id(*args, F.lit(0))).first()[0] != "9eda2a0487ca"


@pytest.mark.parametrize(("seconds", "want"), [(59, "just now"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (200000, "55h ago")])
def test_relative_time(spark, seconds, want):
    assert column(spark, seconds, text.relative_time, "bigint") == want


def test_small_scalars(spark):
    assert column(spark, "'./m.js'", text.strip_quotes) == "./m.js"
    assert column(spark, ": string ", text.return_type) == "string"
    assert column(spark, "http://h//", text.base_url) == "http://h"
    assert column(spark, "\t a \n", text.snippet) == "a"
    assert column(spark, 7, text.zero_pad, "int") == "007" and column(spark, 12345, text.zero_pad, "int") == "12345"
    assert column(spark, " \n\t", text.nonblank) is False
    assert column(spark, "a\r\nb\rc", text.normalise_newlines) == "a\nb\nc"
    assert column(spark, 1, text.plural, "int") == "entry"
    assert column(spark, "x = f(1)", text.token_count) == 6


@pytest.mark.parametrize(("path", "want"), [("a.py", "python"), ("B.PY", "python"), ("d.d/x", None), (".py", None), ("a.b.tsx", "tsx"), (None, None), ("m.go", "go")])
def test_language(spark, path, want):
    assert column(spark, path, lang.language_of) == want
