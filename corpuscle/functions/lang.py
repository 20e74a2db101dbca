"""Language of a path by its suffix (T5, J6), and which languages have a parser."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffix -> language, and the languages that are parsed.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".cpp": "cpp", ".c": "c", ".go": "go"}
PARSED = ("python", "javascript", "typescript", "tsx")


def suffix(path: Column) -> Column:
    """The last suffix of a path's last part, in lower case; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """The language that the suffix stands for, null if none."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LANGUAGES.items()))
    return F.try_element_at(table, suffix(path))


def with_language(files: DataFrame) -> DataFrame:
    """Files with a ``language`` column."""
    return files.withColumn("language", language_of(F.col("path")))


def parsable(files: DataFrame) -> DataFrame:
    """files of a language that has a parser."""
    return with_language(files).filter(F.col("language").isin(*PARSED))
