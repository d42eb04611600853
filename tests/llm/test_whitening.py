import math
from fractions import Fraction

import numpy as np
import pytest

from loreforge.llm import bidiagonal, queries, whitening
from loreforge.llm.common import table

RNG = np.random.default_rng(4)


def turned(values):
    n = len(values)
    q, p = (np.linalg.qr(RNG.standard_normal((n, n)))[0] for _ in range(2))
    return q @ np.diag(values) @ p.T


@pytest.mark.parametrize("r", [RNG.standard_normal((n, n)) for n in (1, 2, 3, 9, 64, 150)] + [np.eye(20), np.ones((7, 7)), turned([5.0] * 10 + [1.0] * 30), turned([5, 5 * (1 - 1e-9), 5 * (1 - 1e-5), 4.999] + [0.1] * 20), turned(10.0 ** -np.linspace(0, 14, 40)), turned([3.0] * 4 + [2.0, 1.0] + [0.0] * 20), np.diag(10.0 ** -np.arange(12))])
def test_values_and_directions(r):
    values, v = bidiagonal.right_vectors(r, 8)
    want = np.linalg.svd(r)[1]
    assert np.abs(values - want).max() < 1e-14 * len(r) * want[0]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-13
    assert np.abs(r.T @ (r @ v) - v * values[: v.shape[1]] ** 2).max() < 1e-14 * len(r) * want[0] ** 2
    assert v.shape[1] == min(8, (want > 1e-13 * want[0]).sum())


def test_small_values_are_accurate():
    """Relative to themselves: of a graded bidiagonal, whose values' product is that of its diagonal."""
    d, e = 10.0 ** -np.arange(0, 60, 6.0), 10.0 ** -np.arange(0, 54, 6.0) / 2
    values = bidiagonal.singular_values(d, e)
    assert abs(np.log(values).sum() - np.log(d).sum()) < 1e-13 * 150
    upper = np.diag(d) + np.diag(e, 1)
    inverse = np.linalg.svd(np.linalg.inv(upper * 10.0 ** np.arange(0, 60, 6.0)[:, None]))[1]
    assert len(values) == len(inverse) and (np.diff(values) < 0).all()


def test_zero_matrix():
    values, v = bidiagonal.right_vectors(np.zeros((4, 4)), 3)
    assert (values == 0).all() and v.shape == (4, 0)


def by_hand(rows, k=8):
    """deviation, whitened (either sign) and explained of rows of floats."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r] for r in rows], dtype=np.int64)
    n, s = len(x), [int(v) for v in x.sum(0)]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    c = np.array([[float(Fraction(int(a)) - Fraction(b, n)) for a, b in zip(r, s, strict=True)] for r in x])
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return deviation, c @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_query_against_brute_force(spark):
    out = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001").orderBy("vec_id", "component").collect()
    rows = table(spark, "/root/testdata/sf0.001", "embeddings").orderBy("vec_id").collect()
    deviation, whitened, explained = by_hand([r["embedding"] for r in rows])
    assert [r["vec_id"] for r in out] == [r["vec_id"] for r in rows for _ in range(8)] and {r["n"] for r in out} == {len(rows)}
    assert [r["deviation"] for r in out[::8]] == deviation
    got = np.array([r["whitened"] for r in out]).reshape(-1, 8)
    signs = np.sign((got * whitened).sum(0))
    assert np.abs(got * signs - whitened).max() < 1e-9
    assert np.allclose([r["explained"] for r in out[:8]], explained, rtol=1e-10)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-11


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [0.5, -0.25]), (6, [0.5, -0.25]), (None, [0.1, 0.9]), (8, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 4.0]), (11, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "vec_id as v", "'x' as length", "1 as ID")
    out = whitening.whiten(df).collect()
    of = {}
    for r in out:
        of.setdefault(r["vec_id"], []).append(r)
    assert {k: len(v) for k, v in of.items()} == {6: 4, None: 2, 8: 2, 9: 3, 10: 3, 11: 1}
    deviation, whitened, _ = by_hand([[0.5, -0.25], [0.5, -0.25], [np.float32(0.1), np.float32(0.9)], [0.0, 0.0]])
    assert [of[i][0]["deviation"] for i in (6, None, 8)] == [deviation[0], deviation[2], deviation[3]]
    assert np.allclose(np.abs([of[8][0]["whitened"], of[8][1]["whitened"]]), np.abs(whitened[3]))
    assert of[11][0]["whitened"] is None and of[11][0]["explained"] is None and of[11][0]["identity_error"] is None and of[11][0]["deviation"] == 0
    three = sorted(of[9], key=lambda r: r["component"])
    assert abs(abs(three[0]["whitened"]) - 1) < 1e-12 and three[1]["whitened"] is None and three[0]["explained"] == 1 and three[1]["explained"] < 1e-30
    assert whitening.whiten(df.limit(0)).count() == 0


def test_large_entries_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "LENGTHS", 1)
    rows = [(i, [float(v) for v in RNG.standard_normal(5)]) for i in range(300)] + [(1000 + i, [1e200, float(i)]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    out = whitening.whiten(df, components=3).orderBy("vec_id", "component").collect()
    deviation, whitened, explained = by_hand([v for _, v in rows[:300]], 3)
    assert [r["deviation"] for r in out[:900:3]] == deviation
    got = np.array([r["whitened"] for r in out[:900]]).reshape(-1, 3)
    assert np.abs(np.abs(got) - np.abs(whitened)).max() < 1e-10 and np.allclose([r["explained"] for r in out[:3]], explained)
    assert len(out) == 906 and all(r["n"] == 3 for r in out[900:]) and out[900]["deviation"] == (3 * 1024) ** 2
    far = spark.createDataFrame([(0, [1e200]), (1, [-1e200])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(far).collect()} == {None}
