"""Embedding whitening: each vector's place on the principal components, scaled to a variance of one.

Entries become whole numbers, floor(1024 c) + 100000, so that counts, sums and the distance from the mean are exact. In a
first pass tasks add them up; in a second one each task centres its rows by the exact mean, ahead of any product, and
reduces them block by block to one triangle by QR. Triangles are merged in tasks of ``FAN`` at most, round after round,
and the last one of each vector length is solved where it is: Householder reflections make it bidiagonal, dqds finds its
singular values and twisted factorisations the directions (see ``bidiagonal``). No square of a sum is ever taken apart, so
the large common offset costs no digits. A third pass projects all rows and adds up the whitened values' means and
centred products, which are merged in the same way and tell how far their covariance is from the identity.

Rows whose vector is null or holds null or non-finite entries are left out, empty vectors have no components. Vectors of
different lengths are fitted apart, each length over its own rows, ``LENGTHS`` of them in a pass over the rows. Rows that repeat
an id or vector count and are returned each; null ids stay null. Components without variance (in double precision) have a null
``whitened``; if no component has any, so with one row, ``explained`` and ``identity_error`` are null, too. Entries of more than
2**52 / 1024 count as that. A ``deviation`` that no long can hold is null. An empty table gives an empty result; other columns
are not read, whatever their names. What the driver and each task hold are the sums and directions of a pass's lengths.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import right_vectors
from .common import freeze, slices

#: Triangles or moments that one task merges; vector lengths of a pass; rows that are reduced at once.
FAN, LENGTHS, BLOCK = 32, 64, 2048
_LARGE = 1 << 52


def whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * 1024.0), -_LARGE, _LARGE).astype(np.int64) + 100_000


def _by_length(batches, column: str, lengths):
    """length, the batch's rows of that length, their entries as whole numbers."""
    for batch in slices(batches, BLOCK):
        lists = batch.column(column)
        sizes = np.diff(lists.offsets.to_numpy())
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        for d in np.unique(sizes).tolist():
            if d in lengths:
                at = np.flatnonzero(sizes == d)
                yield d, batch.take(pa.array(at)), whole(flat[(ends[at] - d)[:, None] + np.arange(d)])


class Mean:
    """The exact mean of the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.fits = max(map(abs, sums), default=0) < 1 << 62
        self.as_long = np.array(sums, np.int64) if self.fits else None

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, as longs if they hold it, else as Python's whole numbers."""
        if self.fits and int(np.abs(x).max(initial=0)) * self.n < 1 << 62:
            return x * self.n - self.as_long
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.apart(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        away = self.apart(x)
        if away.dtype == np.int64 and x.shape[1] * float(np.abs(away).max(initial=0)) ** 2 < 2.0**62:
            return (away**2).sum(1).tolist()
        exact = (away.astype(object) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square upper triangle r with r.T @ r = rows.T @ rows."""
    d = rows.shape[1]
    if len(rows) < d:
        rows = np.concatenate([rows, np.zeros((d - len(rows), d))])
    return np.linalg.qr(rows, mode="r")


def _folded(parts: DataFrame, merge, last=None) -> DataFrame:
    """length, part, body: the bodies of each length, merged FAN at a time in the order of parts until one is left; ``last`` makes something else of that one."""
    parts = freeze(parts, "parts")
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1

    def fold(end):
        def some(table: pa.Table) -> pa.Table:
            d, table = table.column("length")[0].as_py(), table.sort_by("part")
            body = None
            for b in table.column("body").to_pylist():
                body = np.frombuffer(b) if body is None else merge(d, body, np.frombuffer(b))
            body = last(d, body) if end and last else body
            return pa.table({"length": pa.array([d], pa.int32()), "part": pa.array([table.column("part")[0].as_py() // FAN], pa.int64()), "body": pa.array([np.ascontiguousarray(body).tobytes()], pa.binary())})

        return some

    while True:
        n = -(-n // FAN)
        parts = parts.groupBy("length", F.floor(F.col("part") / FAN).alias("bundle")).applyInArrow(fold(n == 1), "length int, part long, body binary")
        if n == 1:
            return parts


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _body(length: int, body: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([_part()], pa.int64()), pa.array([np.ascontiguousarray(body).tobytes()], pa.binary())], names=["length", "part", "body"])


def means(rows: DataFrame, lengths: set) -> dict[int, Mean]:
    """Of each length the exact mean of rows' vectors v."""

    def added(batches):
        total = {}
        for d, _, x in _by_length(batches, "v", lengths):  # in two halves, whose sums no task can overflow
            n, high, low = total.get(d, (0, 0, 0))
            total[d] = n + len(x), high + (x >> 26).sum(0), low + (x & (1 << 26) - 1).sum(0)
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["length", "pos", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = rows.mapInArrow(added, "length int, pos int, n long, high long, low long").groupBy("length", "pos").agg(exact("n"), exact("high"), exact("low"))
    found: dict[int, list] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["length"], r["pos"])):  # a row per length and dimension
        found.setdefault(r["length"], []).append((int(r["n"]), (int(r["high"]) << 26) + int(r["low"])))
    return {d: Mean(v[0][0], [s for _, s in v]) for d, v in found.items()}


def fit(rows: DataFrame, mean: dict[int, Mean], components: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the eigenvalues of the covariance of v, falling, and the first components in columns."""

    def reduced(batches):
        held, waiting = {}, {}
        for d, _, x in _by_length(batches, "v", mean):
            waiting.setdefault(d, []).append(mean[d].centred(x))
            if sum(map(len, waiting[d])) >= max(BLOCK, 2 * d):
                held[d] = triangle(np.concatenate([*waiting.pop(d), *([held[d]] if d in held else [])]))
        for d, rest in waiting.items():
            held[d] = triangle(np.concatenate([*rest, *([held[d]] if d in held else [])]))
        for d, r in held.items():
            yield _body(d, r)

    def merged(d, a, b):
        return triangle(np.concatenate([a.reshape(d, d), b.reshape(d, d)])).ravel()

    def solved(d, r):
        values, directions = right_vectors(r.reshape(d, d), components)
        return np.concatenate([values, directions.ravel()])

    out = {}
    for r in _folded(rows.mapInArrow(reduced, "length int, part long, body binary"), merged, solved).collect():  # a row per length
        d, body = r["length"], np.frombuffer(r["body"])
        out[d] = body[:d] ** 2 / mean[d].n, body[d:].reshape(d, -1)
    return out


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """<id_col>, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall(F.col("v").cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = freeze(named.where(F.coalesce(finite & (F.size("v") > 0), F.lit(False))), "sound")
    doubles = rows.select("id", F.col("v").cast("array<double>").alias("v"))
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())  # a row per length
    out = [_whitened(doubles, set(lengths[k : k + LENGTHS]), components) for k in range(0, max(1, len(lengths)), LENGTHS)]
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_.withColumnRenamed("id", id_col)


def _whitened(rows: DataFrame, lengths: set, components: int) -> DataFrame:
    spark = rows.sparkSession
    mean = means(rows, lengths)
    model = fit(rows, mean, components)
    scale = {d: directions / np.sqrt(values[: directions.shape[1]]) for d, (values, directions) in model.items()}
    id_type, schema = rows.schema["id"].dataType.simpleString(), "length int, part long, deviation long, whitened array<double>, body binary, kind int"

    def project(batches):
        sums = {}
        for d, batch, x in _by_length(batches, "v", mean):
            w = mean[d].centred(x) @ scale[d]
            sums[d] = _moments(sums.get(d), w)
            white = np.full((len(w), min(components, d)), np.nan)
            white[:, : w.shape[1]] = w
            k, n = white.shape[1], len(w)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(n, d), pa.int32()), pa.nulls(n, pa.int64()), pa.array(mean[d].deviations(x), pa.int64()), lists, pa.nulls(n, pa.binary()), pa.array(np.zeros(n), pa.int32())], names=["id", "length", "part", "deviation", "whitened", "body", "kind"])
        for d, m in sums.items():
            ids = pa.nulls(1, id_of[0])
            yield pa.RecordBatch.from_arrays([ids, pa.array([d], pa.int32()), pa.array([_part()], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), pa.array([m.tobytes()], pa.binary()), pa.array([1], pa.int32())], names=["id", "length", "part", "deviation", "whitened", "body", "kind"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_of = (to_arrow_type(rows.schema["id"].dataType),)
    found = freeze(rows.mapInArrow(project, f"id {id_type}, {schema}"), "whitened", "kind")
    moments = _folded(found.where("kind = 1").select("length", "part", "body"), lambda d, a, b: _merged(a, b)).collect()  # a row per length
    told = []
    for r in moments:
        d, m = r["length"], np.frombuffer(r["body"])
        values, k = model[d][0], _width(len(m))
        far = np.abs(m[1 + k :].reshape(k, k) / m[0] - np.eye(k)).max(initial=0)
        total, n_shown = values.sum(), min(components, d)
        told.append((d, mean[d].n, [float(v / total) if total > 0 else None for v in values[:n_shown]], float(far) if k else None))
    of = F.broadcast(spark.createDataFrame(told, "length int, n long, shares array<double>, identity_error double"))  # a row per length
    each = found.where("kind = 0").select("id", "length", "deviation", F.posexplode("whitened").alias("at", "w")).join(of, "length")
    return each.select("id", (F.col("at") + 1).alias("component"), "n", "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"), F.get("shares", F.col("at")).alias("explained"), "identity_error")


def _width(size: int) -> int:
    """k of the size 1 + k + k * k."""
    return (math.isqrt(4 * size - 3) - 1) // 2


def _moments(before: np.ndarray | None, w: np.ndarray) -> np.ndarray:
    """n, means and centred products of w's columns in a row, added to earlier ones."""
    mean = w.mean(0)
    away = w - mean
    new = np.concatenate([[len(w)], mean, (away.T @ away).ravel()])
    return new if before is None else _merged(before, new)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k, n = _width(len(a)), a[0] + b[0]
    step = b[1 : 1 + k] - a[1 : 1 + k]
    return np.concatenate([[n], a[1 : 1 + k] + step * (b[0] / n), a[1 + k :] + b[1 + k :] + np.outer(step, step).ravel() * (a[0] * b[0] / n)])
