"""Embedding near-dedup by an inverted multi-index (Babenko and Lempitsky 2012).

Vectors of each length are looked at alone. Two codebooks, one for each half of the vectors, are trained on a bounded
sample; their product is a grid of cells, and each distinct vector lives in the cell of its nearest codewords. A query goes
through the cells in multi-sequence order, by rising sum of its halves' distances to the codewords, and stops after as many
cells as were needed to reach the target recall on pilot vectors: for each, partners at exactly the threshold, in
random directions, which are the hardest to find. With a recall of 1 it visits all cells, which is exact. Every partner
found is verified in double precision.

The grid grows with the number of vectors: codebooks of more than ``COARSE`` words are nested, a coarse word with fine ones
below it, so that no vector is compared with all of them. A cell's members are dealt into chunks of at most ``CHUNK``, and
so are its queries; each pair of chunks is one block, so that a block's work and memory are bounded. A pair that both of
its vectors can find counts once for each: a block tells by the same order whether the other side finds it too. Vectors
travel in single precision if that holds them (as Spark's float arrays do). Blocks return counts and a spanning forest, not
pairs, and equal vectors enter once with their number.

Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, and vectors of different lengths
don't link. Null ids are not counted as smallest. Rows that repeat an id or vector each get a row; an empty table gives an
empty result; other columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, small
from .components import components, spanning

#: Vectors that codebooks are trained on at most; pilot vectors; vectors in a cell, about; words of a codebook from which it is nested; vectors of a chunk at most.
SAMPLE, PILOTS, CELL, COARSE, CHUNK = 8192, 256, 384, 256, 1024


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from spread-out rows of x."""
    k = min(k, len(x))
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((words**2).sum(1) - 2 * x @ words.T, axis=1)
        sums, counts = np.zeros_like(words), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


class Book:
    """A codebook of k words at most. Beyond COARSE words it is nested: coarse words, and fine ones below each."""

    def __init__(self, x: np.ndarray, k: int):
        k = min(k, len(x))
        if k <= COARSE:
            self.words = codebook(x, k)
            return
        top = codebook(x, round(math.sqrt(k)))
        near = np.argmin((top**2).sum(1) - 2 * x @ top.T, axis=1)
        share = [max(1, round(k * (near == i).mean())) for i in range(len(top))]
        self.words = np.concatenate([codebook(x[near == i], n) if (near == i).any() else top[i : i + 1] for i, n in enumerate(share)])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Up to a term that is the same for all words."""
        return (self.words**2).sum(1) - 2 * x @ self.words.T


class Grid:
    """``words``: of each of the two codebooks."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float, recall: float):
        self.half = sample.shape[1] // 2
        self.books = [Book(sample[:, : self.half], words), Book(sample[:, self.half :], words)]
        self.width = len(self.books[1].words)
        self.cells = len(self.books[0].words) * self.width
        self.visits = self.cells
        if recall < 1:
            rng = np.random.default_rng(7)
            pilots = np.repeat(sample[:: max(1, len(sample) // PILOTS)], 8, axis=0)
            away = rng.standard_normal(pilots.shape)
            away -= (away * pilots).sum(1, keepdims=True) * pilots
            away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
            partners = threshold * pilots + math.sqrt(1 - threshold**2) * away
            self.visits = int(np.quantile(self.ranks(pilots, self.home(partners)), recall, method="higher")) + 1

    def _distances(self, x):
        return [b.distances(y) for b, y in zip(self.books, (x[:, : self.half], x[:, self.half :]), strict=True)]

    def home(self, x: np.ndarray) -> np.ndarray:
        one, two = self._distances(x)
        return one.argmin(1) * self.width + two.argmin(1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells come before the given one in each row's order."""
        one, two = self._distances(x)
        rows, (i, j) = np.arange(len(x)), np.divmod(cells, self.width)
        limit = one[rows, i] + two[rows, j]
        two.sort(axis=1)
        return np.array([np.searchsorted(b, at - a, "left").sum() for a, b, at in zip(one, two, limit, strict=True)])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The first ``visits`` cells of each row in multi-sequence order. The cell of ranks (i, j) comes after
        (i + 1) * (j + 1) - 1 others at least, so only those below that bound are looked at."""
        one, two = self._distances(x)
        first, second = np.argsort(one, axis=1), np.argsort(two, axis=1)
        upto = np.minimum(self.visits // np.arange(1, min(self.visits, one.shape[1]) + 1), self.width)
        i = np.repeat(np.arange(len(upto)), upto)
        j = np.arange(len(i)) - np.repeat(np.cumsum(upto) - upto, upto)
        sums = np.take_along_axis(one, first, 1)[:, i] + np.take_along_axis(two, second, 1)[:, j]
        order = np.argsort(sums, axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(first[:, i], order, 1) * self.width + np.take_along_axis(second[:, j], order, 1)

    def sees(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Of each row and each of the given cells whether the row's search visits it."""
        if self.visits >= self.cells:
            return np.ones((len(x), len(cells)), bool)
        found = np.sort(self.nearest(x), axis=1)
        base = np.arange(len(x))[:, None] * self.cells
        flat = (found + base).ravel()
        wanted = cells[None] + base
        at = np.minimum(np.searchsorted(flat, wanted), len(flat) - 1)
        return flat[at] == wanted


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision. The parts are scaled by their largest first, so that no square overflows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 2))
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _chunks(nodes: np.ndarray, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The chunk of each vector among its cell's n chunks."""
    return (nodes * 2654435761 % 2**31) % n[cells]


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.98) -> DataFrame:
    """<id_col>, n_links, component_id, kept."""
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = freeze(vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast(f"array<{kind}>").alias("v")), "vectors")
    sound = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    sound = F.coalesce(sound, F.lit(False))
    unique = rows.where(sound).groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"))
    unique = freeze(unique.withColumn("node", F.monotonically_increasing_id()), "unique")
    lengths = [r["n"] for r in unique.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]  # a row per length
    found = [_found(unique.where(F.size("v") == n), n, threshold, recall, kind) for n in lengths]
    if not found:
        return rows.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    linked = freeze(components(all_.select(F.col("node").alias("a"), F.col("root").alias("b"))), "linked")
    least = linked.join(unique.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("least"))
    sums = all_.groupBy("node").agg(F.sum("n").alias("n"))
    of_node = freeze(sums.join(linked.join(least, "component").select("node", "least"), "node", "full"), "of_node")
    of_vector = unique.join(small(of_node), "node", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first_id").alias("component_id")
    )
    out = rows.where(sound).join(of_vector, "v").select(id_col, "n_links", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)).alias("kept"))
    rest = rows.where(~sound).select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(rest)


def _found(unique: DataFrame, length: int, threshold: float, recall: float, kind: str) -> DataFrame:
    """node, n, root: what blocks found of vectors of one length."""
    n = unique.count()
    sample = unique.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    # a vector of one part has no second half: its grid is a line
    grid = Grid(_matrix(sample.column("v")), max(1, round(math.sqrt(n / CELL))), threshold, recall)

    def home(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grid.home(_matrix(batch.column(1)))), batch.column(2)], names=["node", "v", "home", "copies"])

    placed = freeze(unique.select("node", "v", "copies").mapInArrow(home, f"node long, v array<{kind}>, home long, copies long"), "placed")

    def visit(batches):  # counts of queries by cell, summed up within the task
        n = np.zeros(grid.cells, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                at, cells = part.column("home").to_numpy(), grid.nearest(_matrix(part.column("v")))
                n += np.bincount(cells.ravel(), minlength=grid.cells)
                n += np.bincount(at[(cells != at[:, None]).all(1)], minlength=grid.cells)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["home", "n"])

    members, queries = np.ones(grid.cells, np.int64), np.ones(grid.cells, np.int64)
    for r in placed.groupBy("home").count().collect():  # a row per cell
        members[r["home"]] = r["count"]
    for r in placed.select("v", "home").mapInArrow(visit, "home long, n long").groupBy("home").agg(F.sum("n").alias("n")).collect():
        queries[r["home"]] = r["n"]
    m_chunks, q_chunks = -(-members // CHUNK), -(-queries // CHUNK)
    first = np.concatenate([[0], np.cumsum(m_chunks * q_chunks)])

    def route(batches):
        """Each member to its chunk with all chunks of queries, each query to its chunk with all chunks of members."""
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                at, node = part.column("home").to_numpy(), part.column("node").to_numpy()
                cells = grid.nearest(_matrix(part.column("v")))
                away = np.column_stack([at, np.where(cells == at[:, None], -1, cells)])  # its own cell always
                row, cell = np.nonzero(away >= 0)[0], away[away >= 0]
                out = []
                for rows, cell, own, other, step, turn in ((np.arange(len(at)), at, m_chunks, q_chunks, True, 0), (row, cell, q_chunks, m_chunks, False, 1)):
                    chunk, n = _chunks(node[rows] + turn, cell, own), other[cell]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    rows, cell, chunk = np.repeat(rows, n), np.repeat(cell, n), np.repeat(chunk, n)
                    block = first[cell] + (chunk * q_chunks[cell] + nth if step else nth * q_chunks[cell] + chunk)
                    out.append((rows, block, np.full(len(rows), step), cell))
                rows, block, member, cell = (np.concatenate(v) for v in zip(*out, strict=True))
                for j in range(0, len(rows), 1 << 14):
                    s = slice(j, j + (1 << 14))
                    own = part.take(pa.array(rows[s]))
                    yield pa.RecordBatch.from_arrays([pa.array(block[s]), own.column("node"), own.column("v"), own.column("home"), own.column("copies"), pa.array(member[s]), pa.array(cell[s])], names=["block", "node", "v", "home", "copies", "member", "cell"])

    routed = placed.mapInArrow(route, f"block long, node long, v array<{kind}>, home long, copies long, member boolean, cell long")

    def compare(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy()
        own, asked = table.filter(pa.array(member)), table.filter(pa.array(~member))
        if not own.num_rows or not asked.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        x, y = _matrix(own.column("v")), _matrix(asked.column("v"))
        here, node, guest = table.column("cell")[0].as_py(), own.column("node").to_numpy(), asked.column("node").to_numpy()
        at, copies, weights = asked.column("home").to_numpy(), own.column("copies").to_numpy(), asked.column("copies").to_numpy()
        cells, place = np.unique(at, return_inverse=True)
        sees = grid.sees(x, cells)  # whether a member's own search comes to a query's cell
        sees[:, cells == here] = True
        i, j = np.nonzero((y @ x.T >= threshold) & (guest[:, None] != node))
        n_own, n_asked = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        np.add.at(n_asked, i, copies[j])
        alone = ~sees[j, place[i]]
        np.add.at(n_own, j[alone], weights[i[alone]])
        names, both = np.unique(np.concatenate([node, guest]), return_inverse=True)
        labels = spanning(len(names), both[len(x) :][i], both[: len(x)][j])
        n = np.bincount(both, weights=np.concatenate([n_own, n_asked]), minlength=len(names)).astype(np.int64)
        kept = np.flatnonzero((n > 0) | (labels != np.arange(len(names))))
        return pa.table({"node": names[kept], "n": n[kept], "root": names[labels[kept]]})

    return freeze(routed.groupBy("block").applyInArrow(compare, "node long, n long, root long"), "found")
