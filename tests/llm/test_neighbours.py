import numpy as np
import pytest

from corpuscle.llm import neighbours as N

KIND = "embedder_id string, chunk_id string, vector array<float>, mark int"


def brute(rows, k=5):
    out = {}
    spaces = {}
    for e, c, v, _ in rows:
        if e and c and v and any(v):
            spaces.setdefault((e, len(v)), {})[c] = v
    for (e, _), members in spaces.items():
        ids = sorted(members)
        x = np.array([members[c] for c in ids], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = np.round(1 - x @ x.T, 12)
        for i, c in enumerate(ids):
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[i, j], ids[j]))
            out[e, c] = [ids[j] for j in order[:k]]
    return out


def clustered(n=900, width=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    which = np.minimum(rng.geometric(0.3, size=n) - 1, 11)  # a third of all in one cluster
    x = centres[which] + 0.25 * rng.normal(size=(n, width))
    return (x * rng.uniform(0.5, 3, size=(n, 1))).astype(np.float32)


def recall(got, want):
    hits = sum(len(set(want[k]) & set(got.get(k, []))) for k in want)
    return hits / max(sum(map(len, want.values())), 1)


@pytest.mark.parametrize("group", [40_000, 90])
def test_recall_and_edge_cases(spark, monkeypatch, group):
    monkeypatch.setattr(N, "GROUP", group)
    monkeypatch.setattr(N, "QUERIES", 3 * group)
    x = clustered()
    rows = [("a", f"{i:05d}", [float(v) for v in x[i]], i) for i in range(len(x))]
    rows += [("a", f"x{i:02d}", [1.0] + [0.0] * 15, 0) for i in range(40)]  # one vector, forty chunks
    rows += [("a", f"y{i}", [2.0, 1.0] + [0.0] * 14, 0) for i in range(3)]
    rows += rows[:50]  # repeats
    rows += [("b", f"b{i}", [float(i), 1.0, 0.5], i) for i in range(4)]  # fewer than k others
    rows += [("c", "only", [1.0, 2.0], 0)]
    rows += [("a", "null", None, 0), ("a", "zero", [0.0] * 16, 0), ("a", "nan", [float("nan")] * 16, 0), ("a", None, [1.0] * 16, 0), (None, "none", [1.0] * 16, 0), ("a", "empty", [], 0)]
    near = N.nearest_neighbours(spark.createDataFrame(rows, KIND)).collect()
    got = {}
    for r in sorted(near, key=lambda r: r["rank"]):
        got.setdefault((r.embedder_id, r.chunk_id), []).append(r.neighbour)
    want = brute([r for r in rows if r[2] is None or not any(v != v for v in r[2])])
    want.pop(("c", "only"))
    assert set(got) == set(want)
    assert all(len(got[k]) == len(set(got[k])) == len(want[k]) and k[1] not in got[k] for k in want)
    assert recall(got, want) > 0.98
    for i in range(40):
        assert got["a", f"x{i:02d}"] == want["a", f"x{i:02d}"]
    assert got["b", "b0"] == want["b", "b0"]


def test_pairs_and_empty(spark):
    rows = [("a", c, v, 0) for c, v in (("p", [1.0, 0.0]), ("q", [1.0, 0.1]), ("r", [0.0, 1.0]))]
    df = spark.createDataFrame(rows, KIND)
    assert {(r.chunk_a, r.chunk_b) for r in N.neighbour_pairs(df).collect()} == {("p", "q"), ("p", "r"), ("q", "r")}
    assert N.neighbour_pairs(df.limit(0)).count() == 0
    assert N.neighbour_pairs(spark.createDataFrame([("a", "z", None, 1)], KIND)).count() == 0


def test_asymmetric_tables_sum_to_the_decoded_product():
    x = clustered(600)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = N.Index(x, 8)
    own = N.nearest(x, index.centroids, 1)[:, 0]
    codes = index.codes(x - index.centroids[own])
    decoded = index.centroids[own] + np.concatenate([b[c] for b, c in zip(index.books, codes)], axis=1)
    tables = index.tables(x[:5])
    approx = x[:5] @ index.centroids[own].T + sum(t[:, c] for t, c in zip(tables, codes))
    assert np.allclose(approx, x[:5] @ decoded.T, atol=1e-4)


def test_bytes_round_trip():
    near = [(0.25, "abc"), (1.5, ""), (0.0, "ü")]
    assert list(N._read(N._write(near))) == near


@pytest.mark.parametrize(("flat", "divided", "most"), [(4, 10_000, 65_536), (4096, 60, 4), (4, 60, 12)])
def test_two_levels_and_divided_lists(monkeypatch, flat, divided, most):
    """The index by itself: recall of every vector's five nearest is about that of one level and undivided lists."""

    def found(n):
        index = N.Index(x, n)
        lists = index.near(x, 1)[0][:, 0].astype(np.int64)
        near, far = index.near(x, N.PROBES)
        visit = [c[(d <= N.REACH * d[0] + 1e-9) & (c >= 0)] for c, d in zip(near, far)]
        rows, _ = N.search_group(index, x, lists, x, visit, 6)
        return sum(len(set(r) & want[i]) for i, r in enumerate(rows.tolist())) / (5 * len(x))

    x = clustered(1500, 12, 5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = x.astype(np.float64) @ x.T
    np.fill_diagonal(score, -9)
    want = [set(r) for r in np.argsort(-score, axis=1)[:, :5].tolist()]
    lists = min(15, most)
    plain = found(lists)
    for name, value in (("FLAT_LISTS", flat), ("DIVIDED", divided), ("PER_LIST", 50)):
        monkeypatch.setattr(N, name, value)
    assert found(lists) > plain - 0.06 and plain > 0.85


def test_many_embedders_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "EMBEDDERS", 4)
    rows = [(f"e{e}", f"c{e}-{i}", [float(i), 1.0, float(e)], i) for e in range(11) for i in range(3)]
    got = N.nearest_neighbours(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 11 * 3 * 2
