"""Building chunks from elements: keys, class context, keep-first dedupe, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import chunk_id
from corpuscle.operators.split import MAX_TOKENS, OVERLAP_LINES, TokenCounter, count_tokens, split_elements


def class_context(name: Column, bases: Column, docstring: Column) -> Column:
    """The lines that open a method's content and name its class."""
    signature = F.concat(F.lit("class "), name, F.when(F.size(F.coalesce(bases, F.array().cast("array<string>"))) > 0, F.concat(F.lit("("), F.array_join(bases, ", "), F.lit(")"))).otherwise(""), F.lit(":"))
    doc = F.when(F.length(docstring) > 0, F.concat(F.lit('\n    """'), docstring, F.lit('"""'))).otherwise("")
    return F.concat(F.lit("# In class "), name, F.lit("\n"), signature, doc, F.lit("\n\n"))


def class_heads(elements: DataFrame) -> DataFrame:
    """What methods need of their class: its key, order, bases and docstring."""
    return elements.filter("type = 'class'").select("repo_path", "path", F.col("name").alias("parent_class"), F.col("seq").alias("class_seq"), F.col("parameters").alias("bases"), F.col("docstring").alias("class_docstring"))


def methods_with_classes(elements: DataFrame) -> DataFrame:
    """Each class of a file with every method of that class name in the file (many to many).

    Null names match nothing. Two classes of one name both take all their methods; dedupe keeps the
    copy of the first.
    """
    return elements.filter("type = 'method'").join(class_heads(elements), ["repo_path", "path", "parent_class"])


def build_chunks(elements: DataFrame, counter: TokenCounter = count_tokens, budget: int = MAX_TOKENS, overlap: int = OVERLAP_LINES, line_mode: str = "exact", context: bool = True, last_modified: Column | None = None) -> DataFrame:
    """Chunks of the elements, before dedupe, with ``order`` and ``segment_order`` for it.

    Order within a file is that of the pipeline: each class and then its methods, then functions;
    imports are never chunked. The class context is not weighed against the budget. The id of a split
    chunk holds its element's first line, with ``line_mode='compat'`` its segment's. Extra columns of
    ``elements`` are dropped. Elements cross to Python once and are shuffled once, for the join.
    """
    given = elements.select("repo_path", "path", "language", "seq", "type", "name", "start_line", "end_line", "content", "docstring", "decorators", "parent_class", "parameters", "return_type")
    pieces = split_elements(given.filter("type <> 'import'"), counter, budget, overlap, line_mode)
    heads = class_heads(given).withColumnRenamed("parent_class", "owner")
    method = F.col("type") == "method"
    rows = pieces.withColumn("owner", F.when(method, F.col("parent_class"))).join(heads, ["repo_path", "path", "owner"], "left").filter(~method | F.col("class_seq").isNotNull())
    prefix = F.when(method, class_context(F.col("parent_class"), F.col("bases"), F.col("class_docstring"))).otherwise("") if context else F.lit("")
    function = F.col("type") == "function"
    named_by = F.col("segment_start") if line_mode == "compat" else F.col("start_line")
    return rows.select(
        chunk_id(F.col("repo_path"), F.col("path"), F.col("name"), F.col("type"), F.col("parent_class"), named_by, F.col("segment")).alias("chunk_id"),
        "repo_path",
        F.col("path").alias("file_path"),
        "language",
        F.col("type").alias("element_type"),
        F.when(F.col("segment").isNull(), F.col("name")).otherwise(F.format_string("%s (part %d/%d)", "name", F.col("segment") + 1, F.col("segments"))).alias("name"),
        F.col("segment_start").alias("start_line"),
        F.col("segment_end").alias("end_line"),
        F.concat(prefix, F.col("content")).alias("content"),
        F.struct("parent_class", "parameters", "return_type", "decorators", "docstring", F.col("segment").alias("split_segment"), F.col("segments").alias("split_total"), (last_modified if last_modified is not None else F.lit(None)).cast("double").alias("last_modified")).alias("meta"),
        F.struct(function.cast("int").alias("group"), F.when(function, 0).otherwise(F.coalesce("class_seq", "seq")).alias("owner"), method.cast("int").alias("member"), F.col("seq").alias("seq")).alias("order"),
        F.coalesce("segment", F.lit(0)).alias("segment_order"),
    )


def keep_first(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Of the rows with one key the first by ``order``, which must be total; a null key is a key.

    A one-row aggregate, so equal keys are folded before the shuffle, however many there are.
    """
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("row")).select("row.*")


def dropped_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """The keys with more than one row and how many rows dedupe drops for each."""
    return rows.groupBy(key).agg((F.count("*") - 1).alias("dropped")).filter("dropped > 0")


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """D1 on built chunks, in the pipeline's order."""
    return keep_first(chunks, "chunk_id", "file_path", "order", "segment_order", "content").drop("order", "segment_order")


def first_class_by_name(elements: DataFrame) -> DataFrame:
    """The first class of each name in a file, with its docstring."""
    w = Window.partitionBy("repo_path", "path", "name").orderBy("seq", "start_line", "content")
    return elements.filter("type = 'class'").withColumn("n", F.row_number().over(w)).filter("n = 1").select("repo_path", F.col("path").alias("file_path"), F.col("name").alias("parent"), F.col("docstring").alias("class_docstring"))


def import_summary(names: Column) -> Column:
    """The first five imports, and how many more there are."""
    n = F.size(names)
    return F.concat(F.array_join(F.slice(names, 1, 5), ", "), F.when(n > 5, F.concat(F.lit(", ... ("), (n - 5).cast("string"), F.lit(" more)"))).otherwise(""))


def file_imports(elements: DataFrame) -> DataFrame:
    """Names imported by each file, in source order; a file without imports has no row."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "name")))
    return elements.filter("type = 'import'").groupBy("repo_path", F.col("path").alias("file_path")).agg(F.transform(ordered, lambda x: x["name"]).alias("imports"))


def enrich(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """Contents with the file's imports, and for methods the class docstring where it is not yet there."""
    joined = (
        chunks.withColumn("parent", F.when(F.col("element_type") == "method", F.nullif(F.col("meta.parent_class"), F.lit(""))))
        .join(file_imports(elements), ["repo_path", "file_path"], "left")
        .join(first_class_by_name(elements), ["repo_path", "file_path", "parent"], "left")
    )
    imports = F.when(F.size("imports") > 0, F.concat(F.lit("# File imports: "), import_summary(F.col("imports"))))
    doc = F.when((F.length("class_docstring") > 0) & ~F.contains("content", "class_docstring"), F.concat(F.lit("# Class "), F.col("parent"), F.lit(" docstring: "), F.col("class_docstring")))
    return joined.withColumn("content", F.concat_ws("\n", imports, doc, "content")).select(*chunks.columns)
