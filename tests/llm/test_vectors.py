import numpy as np

from loreforge.llm import vectors
from tests.llm.test_simhash import closure


def brute(rows, threshold=0.9):
    n, pairs = {i: 0 for i, _ in rows}, []
    sound = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    for length in {len(v) for _, v in sound}:
        ids = [i for i, v in sound if len(v) == length]
        x = np.array([v / np.linalg.norm(v) for _, v in sound if len(v) == length])
        near = x @ x.T >= threshold
        n |= {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
        pairs += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    return n, closure([i for i, _ in rows], pairs), len(pairs)


def data(n, dim, seed):
    rng = np.random.default_rng(seed)
    seeds = rng.standard_normal((n // 4, dim))
    near = seeds[rng.integers(0, len(seeds), n // 2)]
    near = near + 0.4 * np.linalg.norm(near, axis=1, keepdims=True) / np.sqrt(dim) * rng.standard_normal(near.shape)
    one = seeds[0] + 0.05 * rng.standard_normal((n // 4, dim))
    return np.concatenate([seeds, near, one]).round(4)


def test_recall_and_counts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 24)
    monkeypatch.setattr(vectors, "CHUNK", 50)
    rows = [(i, v.tolist()) for i, v in enumerate(data(1200, 16, 1))]
    out = {r["vec_id"]: r for r in vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()}
    n, component, pairs = brute([(i, np.array(v, np.float32).tolist()) for i, v in rows])
    assert all(out[i]["n_links"] <= n[i] for i, _ in rows)
    assert sum(r["n_links"] for r in out.values()) >= 0.95 * 2 * pairs
    assert np.mean([out[i]["component_id"] == component[i] for i, _ in rows]) > 0.95
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [1.0, float("inf"), 0.0]), (10, [1.0, 0.0]), (11, [0.0, 1.0, 0.0]), (12, [1e30, 1e29, 0.0])]
    schema = "vec_id long, embedding array<float>, node long"
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.links(spark.createDataFrame([(*r, 1) for r in rows], schema)).collect()}
    n, component, _ = brute(rows)
    assert out == {i: (n[i], component[i]) for i, _ in rows}
    more = [(20, [0.5, 0.5]), (21, [1.0, 1.0]), (22, [3.0]), (23, [-1.0]), (24, [2.0])]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.links(spark.createDataFrame([(*r, 1) for r in rows + more], schema)).collect()}
    n, component, _ = brute(rows + more)
    assert out == {i: (n[i], component[i]) for i, _ in rows + more} and out[21] == (1, 20) and out[24] == (1, 22)
    assert vectors.links(spark.createDataFrame([], schema)).count() == 0
    assert vectors.links(spark.createDataFrame([(1, None, 1)], schema)).count() == 1


def test_all_cells_are_exact(spark, monkeypatch):
    """A recall of 1 equals brute force, with nested codebooks, chunks on both sides, two lengths and double precision."""
    monkeypatch.setattr(vectors, "CELL", 6)
    monkeypatch.setattr(vectors, "CHUNK", 40)
    monkeypatch.setattr(vectors, "COARSE", 4)
    rows = [(i, v.tolist()) for i, v in enumerate(data(800, 12, 2))] + [(5000 + i, v.tolist()) for i, v in enumerate(data(200, 7, 3))]
    out = {r["vec_id"]: r for r in vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), recall=1).collect()}
    n, component, _ = brute(rows)
    assert {i: (r["n_links"], r["component_id"]) for i, r in out.items()} == {i: (n[i], component[i]) for i, _ in rows}


def test_ranks_are_places_in_the_order(monkeypatch):
    monkeypatch.setattr(vectors, "COARSE", 4)
    x = data(400, 10, 5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = vectors.Grid(x, 9, 0.9, 1)
    order = grid.nearest(x[:50])
    assert all(sorted(o.tolist()) == list(range(grid.cells)) for o in order)
    cells = grid.home(x[100:150])
    assert all(abs(r - o.tolist().index(c)) <= 1 for r, o, c in zip(grid.ranks(x[:50], cells), order, cells, strict=True))  # but for rounding
    grid.visits = 7
    sees = grid.sees(x[:50], np.arange(grid.cells))
    assert all(set(np.flatnonzero(s).tolist()) == set(o[:7].tolist()) for s, o in zip(sees, order, strict=True))
