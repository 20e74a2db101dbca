"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.llm import docpairs, handwritten, leakage, mojibake, neighbours, secrets, splitting, syntax, tokenize, toxicity
from corpuscle.session import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def p4_found(spark, sf_dir):
    """Files that are syntactically invalid for their suffix."""
    return syntax.invalid_files(table(spark, sf_dir, "sources"))


@_query
def p4_rates(spark, sf_dir):
    """Rates of invalid files by repository and language."""
    return syntax.invalid_rates(table(spark, sf_dir, "sources"), table(spark, sf_dir, "parsed_files"))


@_query
def p8_ids(spark, sf_dir):
    """Token ids of every document."""
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


@_query
def p9_found(spark, sf_dir):
    """Documents with the evaluation items that they leak."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


@_query
def p9_report(spark, sf_dir):
    """Leaks by evaluation item."""
    return leakage.leaked_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@_query
def p7_found(spark, sf_dir):
    """Files with at least one garbled line."""
    return mojibake.garbled_files(table(spark, sf_dir, "sources")).select("repo_path", "path").distinct()


@_query
def p7_restored(spark, sf_dir):
    """Garbled files with the predicted chain and the restored content."""
    return mojibake.garbled_files(table(spark, sf_dir, "sources")).distinct()


def _secrets(spark, sf_dir):
    return secrets.secrets_in(table(spark, sf_dir, "sources"), table(spark, sf_dir, "chunks"))


@_query
def p6_found(spark, sf_dir):
    """Lines of sources and chunks on which a secret starts."""
    return _secrets(spark, sf_dir).select("tbl", "rec_key", "line_no").distinct()


@_query
def p6_redacted(spark, sf_dir):
    """Contents that hold secrets, with only the secrets replaced."""
    found = _secrets(spark, sf_dir)
    return found.filter("redacted is not null").select("tbl", "rec_key", "redacted").distinct()


@_query
def p3_found(spark, sf_dir):
    """Files that are generated, minified, third-party copies or blocks of data."""
    return handwritten.file_kinds(table(spark, sf_dir, "sources")).select("repo_path", "path")


@_query
def p3_kinds(spark, sf_dir):
    """The same files with the kind of each."""
    return handwritten.file_kinds(table(spark, sf_dir, "sources"))


@_query
def p5_found(spark, sf_dir):
    """Functions with documentation that is not trivial."""
    return docpairs.documented_functions(table(spark, sf_dir, "sources"), texts=False).distinct()


@_query
def p5_pairs(spark, sf_dir):
    """Code and description of each such function."""
    return docpairs.documented_functions(table(spark, sf_dir, "sources")).distinct()


@_query
def p2_found(spark, sf_dir):
    """Elements that must be cut."""
    return splitting.oversized(table(spark, sf_dir, "elements"))


@_query
def p2_pieces(spark, sf_dir):
    """The pieces of all elements that must be cut, of any type, as new chunks."""
    return splitting.piece_chunks(splitting.split_oversized(table(spark, sf_dir, "elements"))).distinct()


ORACLE_SQL["p2_found"] = "SELECT DISTINCT repo_path, path, name, start_line FROM elements WHERE length(content) > 2000"


@_query
def p1_found(spark, sf_dir):
    """Pairs of chunks of which one is among the five nearest of the other."""
    return neighbours.neighbour_pairs(table(spark, sf_dir, "vector_store"))


@_query
def p1_neighbours(spark, sf_dir):
    """The five nearest chunks of every chunk, with distance and rank."""
    near = neighbours.nearest_neighbours(table(spark, sf_dir, "vector_store"))
    return near.withColumn("distance", F.round("distance", 6))


@_query
def p10_found(spark, sf_dir):
    """Documents with at least one abusive, threatening, hateful or sexually explicit remark."""
    got = toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
    return got.filter("toxic and doc_id is not null").select("doc_id").distinct()


@_query
def p10_scores(spark, sf_dir):
    """The score of every document."""
    got = toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
    return got.select("doc_id", "source", F.round("score", 6).alias("score")).distinct()


@_query
def p10_rates(spark, sf_dir):
    """Rates of such documents by source."""
    return toxicity.toxic_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
