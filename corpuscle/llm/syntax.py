"""Problem 4: source files that do not parse (packrat grammars, full consumption required)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.arrow import map_columns
from corpuscle.llm.grammars import check, syntax_of
from corpuscle.session import spread

_SCHEMA = "repo_path string, path string, language string, valid boolean, position bigint, line bigint, cause string"


def _judge(repos: list, paths: list, contents: list) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in ("repo_path", "path", "language", "valid", "position", "line", "cause")}
    for repo, path, text in zip(repos, paths, contents):
        language = syntax_of(path)
        if language is None or text is None:
            continue
        v = check(text, language, jsx=not path.lower().endswith(".ts"))
        for n, x in (("repo_path", repo), ("path", path), ("language", language), ("valid", v.valid), ("position", None if v.valid else v.position), ("line", None if v.valid else text.count("\n", 0, v.position) + 1), ("cause", v.cause)):
            out[n].append(x)
    return out


def syntax_verdicts(sources: DataFrame) -> DataFrame:
    """One row per distinct verdict on a file: valid, and if not the furthest position, its line and the cause.

    Only files with a checked suffix and non-null content are judged; repeated scans of a file fold
    into one row where they agree. Null repo_path or path: such a row has no suffix (path) or keeps
    its null (repo_path). Empty program texts are valid, an empty JSON text is not. An empty table
    gives an empty result. Contents are read once, in place; only verdicts are shuffled.
    """
    wanted = sources.select("repo_path", "path", "content").filter(F.col("content").isNotNull() & F.lower("path").rlike(r"\.(py|jsx?|ts|go|java|json)$"))
    return map_columns(spread(wanted), ["repo_path", "path", "content"], _judge, _SCHEMA).distinct()


def invalid_files(sources: DataFrame) -> DataFrame:
    """(repo_path, path) of the files that are invalid for their suffix."""
    return syntax_verdicts(sources).filter(~F.col("valid")).select("repo_path", "path").distinct()


def invalid_rates(sources: DataFrame, parsed_files: DataFrame) -> DataFrame:
    """Files, invalid files and their rate by repo_path and language, with the commonest cause.

    The language is that of parsed_files in lower case; where it is null or missing, that of the suffix.
    """
    verdicts = syntax_verdicts(sources).groupBy("repo_path", "path").agg(F.min("valid").alias("valid"), F.max("language").alias("suffix_language"), F.max("cause").alias("cause"))
    named = parsed_files.select("repo_path", F.col("file_path").alias("path"), F.lower(F.trim("language")).alias("named")).groupBy("repo_path", "path").agg(F.max("named").alias("named"))
    known = ["python", "javascript", "typescript", "tsx", "go", "java", "json"]
    return (
        verdicts.join(named, ["repo_path", "path"], "left")
        .withColumn("language", F.when(F.col("named").isin(known), F.col("named")).otherwise(F.col("suffix_language")))
        .groupBy("repo_path", "language")
        .agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.mode("cause", True).alias("main_cause"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
