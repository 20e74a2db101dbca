"""Problem 1: the k most similar vectors of every vector.

Inverted file of coarse centroids with product-quantised residuals: each query is answered from the
lists nearest to it by asymmetric distance tables, and the best candidates are ranked again by their
exact distance. Equal vectors are one entry of the index, so copies cost nothing to search.

The number of lists grows with the vectors; beyond a few thousand they are found over centroids of their
centroids. A list that outgrows its share is divided again in the task that searches it, so a query
meets about as many vectors at any size.

Lists are packed into groups of bounded size by nearness; a list larger than a group is spread over
several. A vector is sent once to each group that holds lists it must visit, index and queries of a
group meet in one task, and only the best of each group are merged.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corpuscle.session import ship_package, spread

K = 5
#: Vectors of a list on average, lists visited by a query, vectors in a group, queries in a task.
PER_LIST, PROBES, GROUP, QUERIES = 256, 12, 40_000, 120_000
#: Lists of all embedders together, which bounds what is sent to workers (16 MB for vectors of 64 numbers); of one embedder from which they are found in two steps, over how many centroids of centroids; entries from which a list is divided in its task.
MOST_LISTS, FLAT_LISTS, TOPS, DIVIDED = 65_536, 4096, 8, 2048
#: Embedders answered at once.
EMBEDDERS = 5000
#: A list is visited only if its centroid is at most this many times as far (squared) as the nearest one, or if nearer lists hold fewer than so many vectors for each neighbour sought: a vector may be alone in its list.
REACH, LEAST_MET = 1.2, 4
#: Training sample for each embedder (rows by hash; PER_SAMPLE for each list where that is more), subspaces, codewords, candidates ranked exactly.
SAMPLE, PER_SAMPLE, SUBSPACES, CODEWORDS, RERANK = 40_000, 12, 8, 256, 200
_BLOCK = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from a random start; empty clusters move to random points."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        label = nearest(x, c, 1)[:, 0]
        count = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        total = np.add.reduceat(x[order], np.minimum(np.r_[0, np.cumsum(count)[:-1]], len(x) - 1), axis=0)
        live = count > 0
        c[live] = total[live] / count[live, None]
        if not live.all():
            c[~live] = x[rng.choice(len(x), int((~live).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int, distances: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Numbers of the n nearest rows of ``c`` for each row of ``x``, nearest first; with their squared distances if asked."""
    n = min(n, len(c))
    half = 0.5 * (c * c).sum(1)
    out = np.empty((len(x), n), dtype=np.int32)
    far = np.empty((len(x), n), dtype=np.float32) if distances else None
    for a in range(0, len(x), 4096):
        s = half - x[a : a + 4096] @ c.T
        if n == 1 and not distances:
            out[a : a + 4096, 0] = s.argmin(1)
        else:
            top = np.argpartition(s, n - 1, axis=1)[:, :n]
            out[a : a + 4096] = np.take_along_axis(top, np.take_along_axis(s, top, 1).argsort(1), 1)
            if distances:
                far[a : a + 4096] = np.maximum(2 * np.take_along_axis(s, out[a : a + 4096], 1) + (x[a : a + 4096] ** 2).sum(1)[:, None], 0)
    return (out, far) if distances else out


class Index:
    """Coarse centroids and the residual codebooks of one embedder, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = sample.shape[1]
        self.tops: np.ndarray | None = None
        if lists <= FLAT_LISTS:
            self.centroids = kmeans(sample, lists).astype(np.float32)
        else:
            self.tops = kmeans(sample, math.ceil(math.sqrt(lists)), 6).astype(np.float32)
            label = nearest(sample, self.tops, 1)[:, 0]
            parts = [sample[label == g] for g in range(len(self.tops))]
            live = [g for g, part in enumerate(parts) if len(part)]
            self.tops = self.tops[live]
            below = [kmeans(parts[g], max(1, round(lists * len(parts[g]) / len(sample)))) for g in live]
            self.first = np.r_[0, np.cumsum([len(c) for c in below])]
            self.centroids = np.concatenate(below).astype(np.float32)
        rest = sample - self.centroids[self.near(sample, 1)[0][:, 0]]
        self.cuts = np.linspace(0, self.width, min(SUBSPACES, self.width) + 1).astype(int)
        self.books = [kmeans(rest[:20_000, a:b], CODEWORDS, 6).astype(np.float32) for a, b in zip(self.cuts, self.cuts[1:])]

    def near(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of the n nearest lists of each row, nearest first; those of the nearest centroids of centroids where there are such."""
        if self.tops is None:
            return nearest(x, self.centroids, n, distances=True)
        n = min(n, len(self.centroids))
        tops = nearest(x, self.tops, TOPS)
        number = np.full((len(x), n), -1, dtype=np.int32)
        far = np.full((len(x), n), np.inf, dtype=np.float32)
        for g in np.unique(tops):
            rows = np.flatnonzero((tops == g).any(1))
            c, d = nearest(x[rows], self.centroids[self.first[g] : self.first[g + 1]], n, distances=True)
            both = np.concatenate([far[rows], d], axis=1)
            names = np.concatenate([number[rows], c + np.int32(self.first[g])], axis=1)
            order = both.argsort(1, kind="stable")[:, :n]
            far[rows], number[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        return number, far

    def codes(self, rest: np.ndarray) -> list[np.ndarray]:
        """Codeword of each residual in each subspace."""
        return [nearest(rest[:, a:b], book, 1)[:, 0] for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)]

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Asymmetric tables: inner product of each query's part with each codeword."""
        return [queries[:, a:b] @ book.T for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)]


def search_group(index: Index, x: np.ndarray, lists: np.ndarray, q: np.ndarray, probes: list[np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, exact distances) of the ``keep`` nearest for each query over the lists of a group; rows may be -1.

    Vectors are of unit length. Approximate scores come from the asymmetric tables, the order of the
    result from the exact inner products in double precision.
    """
    order = np.argsort(lists, kind="stable")
    x, lists = x[order], lists[order]
    present, first = np.unique(lists, return_index=True)
    bounds = np.r_[first, len(lists)]
    codes = index.codes(x - index.centroids[lists])
    if (np.diff(bounds) > DIVIDED).any():
        order, x, codes, present, bounds, probes = divided(order, x, codes, present, bounds, q, probes)
        where = {(int(c), j - int(np.searchsorted(present, c))): j for j, c in enumerate(present)}
    else:
        where = {(int(c), 0): j for j, c in enumerate(present)}
        probes = [[(int(c), 0) for c in p] for p in probes]
    rows = np.full((len(q), keep), -1, dtype=np.int64)
    dist = np.full((len(q), keep), np.inf)
    lead = np.array([p[0][0] if len(p) else -1 for p in probes])
    by_lead = np.argsort(lead, kind="stable")
    take = min(48, RERANK)
    for a in range(0, len(q), _BLOCK):
        block = by_lead[a : a + _BLOCK]
        qb = q[block]
        tables = index.tables(qb)
        pair_q = np.repeat(np.arange(len(block)), [len(probes[i]) for i in block])
        pair_l = np.array([where.get(c, -1) for i in block for c in probes[i]], dtype=np.int64)
        live = pair_l >= 0
        pair_q, pair_l = pair_q[live], pair_l[live]
        if not len(pair_q):
            continue
        slot = np.arange(len(pair_q)) - np.r_[0, np.cumsum(np.bincount(pair_q, minlength=len(block)))[:-1]][pair_q]
        width = int(slot.max()) + 1
        score = np.full((len(block), width * take), -np.inf, dtype=np.float32)
        found = np.full((len(block), width * take), -1, dtype=np.int32)
        by_list = np.argsort(pair_l, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(pair_l[by_list])) + 1, len(by_list)]
        for s, e in zip(cuts, cuts[1:]):
            pairs = by_list[s:e]
            j = pair_l[pairs[0]]
            lo, hi = bounds[j], bounds[j + 1]
            who = pair_q[pairs]
            approx = np.repeat((qb[who] @ index.centroids[present[j]])[:, None], hi - lo, axis=1)
            for t, c in zip(tables, codes):
                approx += t[who][:, c[lo:hi]]
            n = min(take, hi - lo)
            top = np.argpartition(-approx, n - 1, axis=1)[:, :n] if hi - lo > n else np.broadcast_to(np.arange(n), (len(who), n))
            at = slot[pairs][:, None] * take + np.arange(n)
            score[who[:, None], at] = np.take_along_axis(approx, top, 1)
            found[who[:, None], at] = top + lo
        n = min(RERANK, score.shape[1])
        best = np.argpartition(-score, n - 1, axis=1)[:, :n] if score.shape[1] > n else np.broadcast_to(np.arange(n), (len(block), n))
        cand = np.take_along_axis(found, best, 1)
        near = np.einsum("qd,qnd->qn", qb, x[np.maximum(cand, 0)])
        near[cand < 0] = -np.inf
        m = min(keep + 3, n)
        last = np.argpartition(-near, m - 1, axis=1)[:, :m] if n > m else np.broadcast_to(np.arange(n), (len(block), n))
        cand = np.take_along_axis(cand, last, 1)
        exact = 1.0 - np.einsum("qd,qnd->qn", qb.astype(np.float64), x[np.maximum(cand, 0)].astype(np.float64))
        exact[cand < 0] = np.inf
        by = exact.argsort(1, kind="stable")[:, :keep]
        cand = np.take_along_axis(cand, by, 1)
        rows[block, : by.shape[1]] = np.where(cand >= 0, order[np.maximum(cand, 0)], -1)
        dist[block, : by.shape[1]] = np.take_along_axis(exact, by, 1)
    return rows, dist


def divided(order: np.ndarray, x: np.ndarray, codes: list[np.ndarray], present: np.ndarray, bounds: np.ndarray, q: np.ndarray, probes: list) -> tuple:
    """The entries of a group with its large lists divided by local centroids, and the (list, division) pairs that each query visits."""
    asked: dict[int, list[int]] = {}
    for i, p in enumerate(probes):
        for c in p:
            asked.setdefault(int(c), []).append(i)
    by, names, cuts = [], [], [0]
    pairs: list[list[tuple[int, int]]] = [[] for _ in probes]
    for j, c in enumerate(present):
        lo, hi = bounds[j], bounds[j + 1]
        who = asked.get(int(c), [])
        if hi - lo <= DIVIDED:
            by.append(np.arange(lo, hi))
            names.append(c)
            cuts.append(cuts[-1] + hi - lo)
            for i in who:
                pairs[i].append((int(c), 0))
            continue
        own = kmeans(x[lo:hi], math.ceil((hi - lo) / PER_LIST), 5)
        label = nearest(x[lo:hi], own, 1)[:, 0]
        inside = np.argsort(label, kind="stable")
        by.append(lo + inside)
        count = np.bincount(label, minlength=len(own))
        names += [c] * len(own)
        cuts += (cuts[-1] + np.cumsum(count)).tolist()
        if who:
            visits = nearest(q[who], own, PROBES)
            for i, v in zip(who, visits):
                pairs[i] += [(int(c), int(d)) for d in v]
    new = np.concatenate(by)
    return order[new], x[new], [t[new] for t in codes], np.array(names), np.array(cuts), pairs


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length from a list<float> column without nulls, all of one width."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    x = flat.reshape(len(column), -1)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], type=pa.binary())


def _from_binary(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


_STATS = "space int, list int, homes bigint, asks bigint"
_SENT = "task bigint, space int, mark bigint, ids array<string>, list int, vector binary, probes binary"
_SOLVED = "space int, mark bigint, ids array<string>, near binary"
_COPIES = "space string, mark bigint, ids array<string>"
_NEAR = "space string, chunk_id string, neighbour string, distance double, rank int"


def _arrow(columns: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(columns))


def nearest_neighbours(store: DataFrame, k: int = K, probes: int = PROBES) -> DataFrame:
    """(embedder_id, chunk_id, neighbour, distance, rank): the k nearest chunks of every chunk of its embedder.

    Distance is 1 minus cosine similarity, ties by smaller neighbour. Null, empty and all-zero vectors
    take no part, nor do rows with a null chunk_id or embedder_id; vectors of an embedder with another
    width than its commonest are a space of their own. Repeated rows count once. A chunk with fewer
    than k others gets those there are. Every row is indexed and every row is a query; only the
    centroids and codebooks are fitted on a sample, of SAMPLE rows an embedder or PER_SAMPLE a list.
    """
    spark = store.sparkSession
    ship_package(spark)
    base = (
        store.select("embedder_id", "chunk_id", "vector")
        .filter("embedder_id is not null and chunk_id is not null and size(vector) > 0 and exists(vector, v -> v <> 0) and not exists(vector, v -> v is null or isnan(v) or abs(v) = float('inf'))")
        .withColumn("space", F.concat_ws(":", "embedder_id", F.size("vector")))
        .withColumn("mark", F.xxhash64("vector"))
    )
    spaces = base.groupBy("space").agg(F.count("*").alias("n"), F.min("mark").alias("least"))
    number = spaces.count()
    if not number:
        return spark.createDataFrame([], "embedder_id string, chunk_id string, neighbour string, distance double, rank int")
    if number > EMBEDDERS:
        parts = math.ceil(1.2 * number / EMBEDDERS)
        out = None
        for part in range(parts):
            space = F.concat_ws(":", "embedder_id", F.size("vector"))
            some = nearest_neighbours(store.filter(F.pmod(F.xxhash64(space, F.lit(number)), F.lit(parts)) == part), k, probes)
            out = some if out is None else out.unionByName(some)
        return out
    sizes = {r[0]: (r[1], r[2]) for r in spaces.collect()}
    names = sorted(sizes)
    models = _fit(base, sizes)
    sent = spark.sparkContext.broadcast((names, models))  # at most MOST_LISTS centroids, and one an embedder
    stats_schema, sent_schema, solved_schema, near_schema = (_arrow(c) for c in (_STATS, _SENT, _SOLVED, _NEAR))

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[list[str]], np.ndarray, list[np.ndarray], np.ndarray]]:
        """(space, marks, smallest ids, unit vectors, lists to visit, lists by nearness) of each batch, equal vectors folded."""
        number = {n: i for i, n in enumerate(sent.value[0])}
        for batch in batches:
            space = np.array(batch.column("space").to_pylist(), dtype=object)
            for name in dict.fromkeys(space):
                part = batch.take(pa.array(np.flatnonzero(space == name)))
                marks, first, fold = np.unique(part.column("mark").to_numpy(), return_index=True, return_inverse=True)
                ids: list[list[str]] = [[] for _ in marks]
                for j, c in zip(fold, part.column("chunk_id").to_pylist()):
                    if len(ids[j]) < 4 * k:
                        ids[j].append(c)
                    else:
                        ids[j] = sorted({*ids[j], c})[: k + 1]
                x = _unit(part.column("vector").take(pa.array(first)))
                index = sent.value[1][number[name]]
                near, far = index.near(x, probes)
                visit = [c[d <= REACH * d[0] + 1e-9] for c, d in zip(near, far)]
                yield number[name], marks, [sorted(set(v))[: k + 1] for v in ids], x, visit, near

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: dict[tuple[int, int], int] = {}
        asks: dict[tuple[int, int], int] = {}
        for s, _, _, _, visit, _ in prepared(batches):
            own, n = np.unique([c[0] for c in visit], return_counts=True)
            for c, m in zip(own, n):
                homes[s, int(c)] = homes.get((s, int(c)), 0) + int(m)
            every, n = np.unique(np.concatenate(visit), return_counts=True)
            for c, m in zip(every, n):
                asks[s, int(c)] = asks.get((s, int(c)), 0) + int(m)
        keys = sorted(asks)
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()), pa.array([homes.get(key, 0) for key in keys], pa.int64()), pa.array([asks[key] for key in keys], pa.int64())], schema=stats_schema)

    rows = spread(base.select("space", "mark", "chunk_id", "vector"))
    stats = rows.mapInArrow(measure, _STATS).groupBy("space", "list").agg(F.sum("homes"), F.sum("asks")).collect()  # a row a list
    packed = spark.sparkContext.broadcast(_pack(models, {(r[0], r[1]): r[2] for r in stats}, {(r[0], r[1]): r[3] for r in stats}))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, marks, ids, x, visit, near in prepared(batches):
            first, over, parts, base_task, held = packed.value[s]
            for i, c in enumerate(visit):
                if held[c].sum() <= LEAST_MET * k:
                    row = near[i][near[i] >= 0]
                    visit[i] = row[: max(len(c), int((held[row].cumsum() <= LEAST_MET * k).sum()) + 1)]
            at: list[int] = []
            tasks: list[int] = []
            own: list[list[str] | None] = []
            lists: list[int | None] = []
            asks: list[bytes | None] = []
            for i, (mark, c) in enumerate(zip(marks.tolist(), visit)):
                h = _mix(mark)
                home = int(first[c[0]]) + h % over[c[0]]
                want = {int(first[j]) + b for j in c for b in range(over[j])}
                for t in {home, *want}:
                    mine = (h >> 20) % parts[t] if t in want else -1
                    for part in range(parts[t]) if t == home else (mine,):
                        at.append(i)
                        tasks.append((base_task + t) * 4096 + part)
                        own.append(ids[i] if t == home else None)
                        lists.append(int(c[0]) if t == home else None)
                        asks.append(c.tobytes() if part == mine else None)
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array(np.full(len(at), s, dtype=np.int32)), pa.array(marks[at], pa.int64()), pa.array(own, pa.list_(pa.string())), pa.array(lists, pa.int32()), _binary(x).take(pa.array(at, pa.int64())), pa.array(asks, pa.binary())], schema=sent_schema)

    def solve(table: pa.Table) -> pa.Table:
        s = table.column("space")[0].as_py()
        index = sent.value[1][s]
        marks = table.column("mark").to_numpy()
        entry = np.flatnonzero(np.asarray(table.column("list").is_valid()))
        asks = np.flatnonzero(np.asarray(table.column("probes").is_valid()))
        entry = entry[np.argsort(marks[entry], kind="stable")]
        unique, first = np.unique(marks[entry], return_index=True)
        ids = table.column("ids").take(pa.array(entry)).to_pylist()
        if len(unique) < len(entry):  # equal vectors from several batches
            ends = np.r_[first[1:], len(entry)]
            ids = [ids[a] if e - a == 1 else sorted({c for v in ids[a:e] for c in v})[: k + 1] for a, e in zip(first, ends)]
            entry = entry[first]
        asks = asks[np.unique(marks[asks], return_index=True)[1]]
        if not len(asks) or not len(entry):
            return pa.Table.from_pylist([], schema=solved_schema)
        x = _from_binary(table.column("vector"), np.float32).reshape(-1, index.width)
        wanted = [np.frombuffer(p, dtype=np.int32) for p in table.column("probes").take(pa.array(asks)).to_pylist()]
        lists = table.column("list").take(pa.array(entry)).to_numpy().astype(np.int64)
        found, dist = search_group(index, x[entry], lists, x[asks], wanted, k + 1)
        place = {m: j for j, m in enumerate(unique.tolist())}
        own, near = [], []
        for m, row, d in zip(marks[asks].tolist(), found.tolist(), dist.tolist()):
            j = place.get(m, -2)
            own.append(ids[j] if j >= 0 else None)
            best = [(v, c) for r, v in zip(row, d) if r >= 0 and r != j for c in ids[r]]
            near.append(_write(best[: k + 2] if len(best) <= k + 2 else sorted(best)[: k + 1]))
        return pa.Table.from_arrays([pa.array(np.full(len(asks), s, dtype=np.int32)), pa.array(marks[asks], pa.int64()), pa.array(own, pa.list_(pa.string())), pa.array(near, pa.binary())], schema=solved_schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for s, own, parts in zip(*(batch.column(c).to_pylist() for c in ("space", "ids", "near"))):
                if not own or len(own) > k:  # a group of so many copies is answered by itself
                    continue
                best: dict[str, float] = {}
                for p in parts:
                    for d, c in _read(p):
                        if d < best.get(c, math.inf):
                            best[c] = d
                order = sorted((d, c) for c, d in best.items())
                for chunk in own:
                    got = ([(0.0, c) for c in own if c != chunk] + [e for e in order if e[1] not in own])[:k]
                    for col, v in zip(out, ([sent.value[0][s]] * len(got), [chunk] * len(got), [c for _, c in got], [d for d, _ in got], range(1, len(got) + 1))):
                        col.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, near_schema)], schema=near_schema)

    solved = rows.mapInArrow(send, _SENT).groupBy("task").applyInArrow(solve, _SOLVED)
    merged = solved.groupBy("space", "mark").agg(F.first("ids", ignorenulls=True).alias("ids"), F.collect_list("near").alias("near"))
    found = merged.select("space", "ids", "near").mapInArrow(finish, _NEAR)
    return found.unionByName(_copies(base, k)).select(F.regexp_extract("space", r"^(.*):\d+$", 1).alias("embedder_id"), "chunk_id", "neighbour", "distance", "rank")


def _fit(base: DataFrame, sizes: dict[str, tuple[int, int]]) -> list[Index]:
    """The models of all embedders, by name; each is trained in a task of its own, all in one job."""
    spark = base.sparkSession
    total = sum(n for n, _ in sizes.values())
    lists = {s: max(1, min(math.ceil(n / PER_LIST), n * MOST_LISTS // total)) for s, (n, _) in sizes.items()}
    rows = [(s, int(min(1.0, max(SAMPLE, PER_SAMPLE * lists[s]) / n) * (1 << 30)), least, lists[s]) for s, (n, least) in sizes.items()]
    drawn = F.broadcast(spark.createDataFrame(rows, "space string, share bigint, least bigint, lists int"))
    # the vector of least mark is drawn too, lest an embedder with few different vectors have none
    sample = base.join(drawn, "space").filter((F.pmod(F.xxhash64("mark", F.lit(11)), F.lit(1 << 30)) < F.col("share")) | (F.col("mark") == F.col("least")))
    schema = _arrow("space string, model binary")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("mark")
        x = _unit(table.column("vector").combine_chunks())
        model = Index(x, min(table.column("lists")[0].as_py(), max(1, len(x) // 8)))
        return pa.Table.from_pydict({"space": [table.column("space")[0].as_py()], "model": [pickle.dumps(model)]}, schema=schema)

    folded = sample.groupBy("space", "mark").agg(F.first("vector").alias("vector"), F.first("lists").alias("lists"))
    got = {r[0]: pickle.loads(r[1]) for r in folded.groupBy("space").applyInArrow(run, "space string, model binary").collect()}
    return [got[s] for s in sorted(sizes)]


def _write(near: list[tuple[float, str]]) -> bytes:
    """Neighbours as bytes: a double and a length-prefixed id each."""
    return b"".join(struct.pack("<dH", d, len(b)) + b for d, b in ((d, c.encode()) for d, c in near))


def _read(data: bytes) -> Iterator[tuple[float, str]]:
    at = 0
    while at < len(data):
        d, n = struct.unpack_from("<dH", data, at)
        yield d, data[at + 10 : at + 10 + n].decode()
        at += 10 + n


def _mix(mark: int) -> int:
    """Spread the bits of a hash, whose low ones partition already."""
    return (mark * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 17


def _pack(models: list[Index], homes: dict[tuple[int, int], int], asks: dict[tuple[int, int], int]) -> list[tuple[np.ndarray, list[int], list[int], int, np.ndarray]]:
    """For each embedder: first task of each list, over how many tasks it is spread, shares of each task's queries, tasks before, vectors of each list.

    Lists near each other share a task while together they have at most GROUP vectors; a larger list
    has tasks of its own, each with a part of it. A task with more than QUERIES queries is shared out.
    """
    out, before = [], 0
    for s, index in enumerate(models):
        n = [homes.get((s, c), 0) for c in range(len(index.centroids))]
        first = np.zeros(len(n), dtype=np.int64)
        over = [max(1, math.ceil(x / GROUP)) for x in n]
        load: list[int] = []
        coarse = kmeans(index.centroids, max(1, math.ceil(1.3 * sum(n) / GROUP)), 10)
        region = nearest(index.centroids, coarse, 1)[:, 0]
        for r in range(len(coarse)):
            room = GROUP + 1
            for c in np.flatnonzero(region == r):
                q = asks.get((s, int(c)), 0)
                if over[c] > 1:
                    first[c] = len(load)
                    load += [q] * over[c]
                    room = GROUP + 1
                    continue
                if room + n[c] > GROUP:
                    load.append(0)
                    room = 0
                first[c] = len(load) - 1
                load[-1] += q
                room += n[c]
        out.append((first, over, [max(1, math.ceil(q / QUERIES)) for q in load], before, np.array(n)))
        before += len(load)
    return out


def _copies(base: DataFrame, k: int) -> DataFrame:
    """Neighbours of the chunks that have at least k others of equal vector: the smallest ids, at distance 0.

    k + 1 ids of each partition are kept first, so that no task holds a large set of copies, and the
    members of a set are joined to its ids by a key that the adaptive plan splits where it is skewed.
    """
    schema = _arrow(_COPIES)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[str]] = {}
        for batch in batches:
            for s, m, c in zip(*(batch.column(n).to_pylist() for n in ("space", "mark", "chunk_id"))):
                got = held.setdefault((s, m), [])
                got.append(c)
                if len(got) > 8 * k:
                    held[s, m] = sorted(set(got))[: k + 1]
        for a in range(0, len(held), 50_000):
            part = list(held.items())[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([s for (s, _), _ in part], pa.string()), pa.array([m for (_, m), _ in part], pa.int64()), pa.array([sorted(set(v))[: k + 1] for _, v in part], pa.list_(pa.string()))], schema=schema)

    ids = base.select("space", "mark", "chunk_id").mapInArrow(smallest, _COPIES).groupBy("space", "mark").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")).filter(F.size("ids") > k)
    members = base.select("space", "mark", "chunk_id").join(ids, ["space", "mark"])
    others = F.slice(F.filter("ids", lambda i: i != F.col("chunk_id")), 1, k)
    return members.select("space", "chunk_id", F.posexplode(others).alias("pos", "neighbour")).select("space", "chunk_id", "neighbour", F.lit(0.0).alias("distance"), (F.col("pos") + 1).alias("rank")).distinct()


def neighbour_pairs(store: DataFrame, k: int = K) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: at least one is among the k nearest of the other."""
    near = nearest_neighbours(store, k)
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()
