"""Vector search (G5, G6, J7, O3): exact top-k by several distances, scoped, single or for a set of queries."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import ship_package

METRICS = ("l2sq", "l2", "cosine", "ip")
#: Queries in a block, and decimals to which distances are compared.
BLOCK, DECIMALS = 2048, 6


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(vector: Column, query: list[float], metric: str = "l2sq") -> Column:
    """Distance of a vector column to a query vector, a literal in the plan; computed in doubles in the JVM.

    Null for null vectors and for another width; cosine is null where a vector is all zero.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric in ("l2sq", "l2"):
        d = F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
        d = F.sqrt(d) if metric == "l2" else d
    elif metric == "ip":
        d = -_dot(vector, q)
    elif metric == "cosine":
        norm = F.sqrt(_dot(vector, vector)) * F.lit(float(np.linalg.norm(np.asarray(query, dtype=np.float64))))
        d = F.lit(1.0) - _dot(vector, q) / F.nullif(norm, F.lit(0.0))
    else:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    return F.when(F.size(vector) == len(query), d)


def scoped(store: DataFrame, repo_path: str | None = None) -> DataFrame:
    """the rows of one repository; no or an empty path scopes nothing."""
    return store.filter(F.col("repo_path") == repo_path) if repo_path else store


def conjunction(**equal: object) -> Column:
    """all the equalities together; a single one, or always true without any. Nulls are left out."""
    tests = [F.col(k) == F.lit(v) for k, v in equal.items() if v is not None]
    return functools.reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def top_k(store: DataFrame, query: list[float], k: int = 5, key: str = "chunk_id", vector: str = "vector", metric: str = "l2sq") -> DataFrame:
    """The k nearest rows, with ``distance`` (rounded) and ``rank`` from 1; fewer where fewer exist.

    Ties rank by key. Rows with a null, empty or other-width vector are passed over. Each partition
    keeps its k best (TakeOrderedAndProject); the store is never sorted.
    """
    near = store.withColumn("distance", F.round(distance(F.col(vector), query, metric), DECIMALS)).filter("distance is not null")
    best = near.orderBy("distance", key).limit(k)
    rest = F.struct(*[c for c in near.columns if c not in ("distance", key)])
    flat = best.agg(F.array_sort(F.collect_list(F.struct("distance", key, rest.alias("rest")))).alias("hits")).select(F.posexplode("hits").alias("pos", "hit"))
    return flat.select(f"hit.{key}", "hit.distance", (F.col("pos") + 1).alias("rank"), "hit.rest.*")


def top_k_of_many(store: DataFrame, queries: DataFrame, k: int = 5, key: str = "chunk_id", vector: str = "vector", metric: str = "l2sq") -> DataFrame:
    """(query key, key, distance, rank): the k nearest rows of ``store`` for each row of ``queries``.

    Queries go out in blocks of bounded size, each block meets every partition once as a matrix
    product, and only k rows a query leave a partition. Vectors must be of one width; null ones and
    those of another width are passed over. A query finds itself if it is in the store.
    """
    spark = store.sparkSession
    ship_package(spark)
    kind = store.schema[key].dataType.simpleString()
    schema = f"query_{key} {kind}, {key} {kind}, distance double"
    base = store.select(key, vector).filter(F.col(vector).isNotNull())
    out = spark.createDataFrame([], schema)
    block: list = []

    def against(rows: list) -> DataFrame:
        width = len(rows[0][1])
        same = [r for r in rows if len(r[1]) == width]
        sent = spark.sparkContext.broadcast(([r[0] for r in same], np.array([r[1] for r in same], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best_d = np.full((len(q), 0), np.inf)
            best_i = np.empty((len(q), 0), dtype=object)
            for batch in batches:
                ids, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                keep = [i for i, v in enumerate(vs) if v is not None and len(v) == q.shape[1]]
                for a in range(0, len(keep), 4096):
                    part = keep[a : a + 4096]
                    x = np.array([vs[i] for i in part], dtype=np.float64)
                    d = np.round(pairwise(q, x, metric), DECIMALS)
                    d = np.concatenate([best_d, d], axis=1)
                    i = np.concatenate([best_i, np.broadcast_to(np.array([ids[j] for j in part], dtype=object), (len(q), len(part)))], axis=1)
                    rank = np.stack([np.lexsort((i[r], d[r]))[:k] for r in range(len(q))])
                    best_d, best_i = np.take_along_axis(d, rank, 1), np.take_along_axis(i, rank, 1)
            live = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=object), live.sum(1)).tolist()), pa.array(best_i[live].tolist()), pa.array(best_d[live])], names=[f"query_{key}", key, "distance"])

        return base.mapInArrow(run, schema)

    for row in queries.select(key, vector).filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).distinct().toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            out, block = out.unionByName(against(block)), []
    if block:
        out = out.unionByName(against(block))
    near = out.distinct().groupBy(f"query_{key}").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", key))), 1, k).alias("near"))
    return near.select(f"query_{key}", F.posexplode("near").alias("pos", "n")).select(f"query_{key}", f"n.{key}", "n.distance", (F.col("pos") + 1).alias("rank"))


def pairwise(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of q to each row of x; inf where cosine has none."""
    dot = q @ x.T
    if metric == "ip":
        return -dot
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 0, 1 - dot / n, np.inf)
    d = np.maximum((q * q).sum(1)[:, None] - 2 * dot + (x * x).sum(1)[None], 0)
    return np.sqrt(d) if metric == "l2" else d


def hydrate(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with the chunks' columns; hits without a chunk are dropped."""
    return hits.join(chunks, key, "inner")
