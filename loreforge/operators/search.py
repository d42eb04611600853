"""Retrieval for many queries at once. Ranks break ties by the smallest id, after rounding the score."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.tables import keep
from .index import Index, counts, term_stats

#: Vectors of a block at most, of a cell about, and queries whose true neighbours say how many cells to visit.
BLOCK, CELL, PILOTS = 4096, 32, 64
#: Shards of a table of cells at least, where these hold more than ``BLOCK`` vectors; numbers of a shard's vectors, or of a block of its queries, about.
SHARDS, VALUES = 16, 1 << 21
#: Rows of a block of documents' terms, about.
TERMS = 1 << 17
#: Terms whose counts go to each task at most.
FREQUENT = 1 << 19
#: Postings of a block of documents, and terms of a block of queries, about.
POSTINGS, ASKED = 1 << 22, 1 << 22


def ranked(scores: DataFrame, key: str, item: str, k: int, score: str = "score") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def boolean_search(postings: DataFrame, must: list[str], should: list[str], must_not: list[str]) -> DataFrame:
    """doc_id: all of must, one of should at least (if any are given) and none of must_not. One pass over the postings of those terms."""
    has = lambda t: F.max((F.col("term") == t).cast("int")) == 1
    wanted = [has(t) for t in must] + ([F.max(F.col("term").isin(should).cast("int")) == 1] if should else []) + [~has(t) for t in must_not]
    out = postings.where(F.col("term").isin([*must, *should, *must_not])).groupBy("doc_id").agg(*[w.alias(f"c{i}") for i, w in enumerate(wanted)])
    for i in range(len(wanted)):
        out = out.where(f"c{i}")
    return out.select("doc_id")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term. queries: query_id, text."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))


def _scored(index: Index, queries: DataFrame, part, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the sums of part(tf, dl, df) over the postings of each query's terms.

    The queries go to the index's buckets, and the postings of their terms, each once for ``ASKED`` of the queries' terms, to blocks of documents, where all
    queries, a row each, are scored and k rows of each leave. So the pairs of a query and a document that share a term, whose number is the product of both sides', stay in tasks."""
    terms = query_terms(queries)
    numbers = index.terms.select("term", "number", "df")
    asked = terms.join(numbers, "term").groupBy("query_id").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    sizes = terms.groupBy("term").agg(F.count(F.lit(1)).alias("times")).join(numbers, "term").agg(F.sum("df"), F.sum("times")).first()
    nd, nq = -(-(sizes[0] or 0) // POSTINGS) or 1, -(-(sizes[1] or 0) // ASKED) or 1
    found = index.hits(terms.select("term").distinct(), "doc_id", "tf", "dl").select("number", "df", "doc_id", "tf", "dl")
    block = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def best(q: pa.Table, d: pa.Table) -> pa.Table:
        out, kind = [], q.schema.field("query_id").type
        empty = pa.table({"query_id": pa.array([], kind), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not q.num_rows or not d.num_rows:
            return empty
        numbers, df, tf, dl = (d.column(c).to_numpy() for c in ("number", "df", "tf", "dl"))
        ids, at = np.unique(d.column("doc_id").to_numpy(), return_inverse=True)
        order = np.argsort(numbers, kind="stable")
        numbers, at, df, tf, dl = numbers[order], at[order], df[order], tf[order], dl[order]
        lists = q.column("numbers").combine_chunks()
        asked, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        first, last = np.searchsorted(numbers, asked, "left"), np.searchsorted(numbers, asked, "right")
        weights = part(tf, dl, df)
        sums, met = np.zeros(len(ids)), np.zeros(len(ids), bool)
        for row in range(q.num_rows):
            for i in range(bounds[row] - bounds[0], bounds[row + 1] - bounds[0]):  # a term is once in a document
                own = at[first[i] : last[i]]
                sums[own] += weights[first[i] : last[i]]
                met[own] = True
            found = np.flatnonzero(met)
            score = np.floor(sums[found] * 1e6 + 0.5)
            if len(found) > k:  # the k best, and of equal ones those with the smallest ids
                low = np.partition(score, len(score) - k)[len(score) - k]
                over = score > low
                found = found[np.concatenate([np.flatnonzero(over), np.flatnonzero(score == low)[: k - over.sum()]])]
            out.append((np.full(len(found), row), ids[found], sums[found]))
            sums[:], met[:] = 0, False
        row, ids, score = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"query_id": q.column("query_id").take(pa.array(row)), "doc_id": ids, "score": score})

    left, right = asked.withColumn("qb", block("query_id", nq)).withColumn("db", every(nd)), found.withColumn("db", block("doc_id", nd)).withColumn("qb", every(nq))
    left, right = left.select("qb", "db", "query_id", "numbers"), right.select(*[F.col(c).alias(c) for c in ("qb", "db", "number", "df", "doc_id", "tf", "dl")])  # both read the index's terms
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id long, score double"
    parts = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(best, schema)
    return ranked(parts.withColumn("score", F.round("score", 6)), "query_id", "doc_id", k)


def bm25(index: Index, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank. queries: query_id, text."""
    n, mean = index.n, index.mean_length
    return _scored(index, queries, lambda tf, dl, df: np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)), k)


def tfidf(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank by the sum of (1 + ln tf) * ln(n / df)."""
    n = index.n
    return _scored(index, queries, lambda tf, dl, df: (1 + np.log(tf)) * np.log(n / df), k)


def _often(df: DataFrame) -> DataFrame:
    """Of term, df the most frequent terms, ``FREQUENT`` at most."""
    octave, most, least = F.floor(F.log2("df") * 4), 0, None
    for r in sorted(df.groupBy(octave.alias("o")).count().collect(), key=lambda r: -r["o"]):  # some hundred rows
        most += r["count"]
        if most > FREQUENT:
            break
        least = r["o"]
    return df.where(octave >= least) if least is not None else df.limit(0)


def top_terms(documents: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, term, weight, rank. Postings of frequent terms meet their counts where they are; only those of rare terms are shuffled."""
    found = keep(counts(documents), "counts")
    df, n = keep(term_stats(found).select("term", "df"), "df"), documents.count()
    near = found.join(F.broadcast(_often(df)), "term", "left")
    rare = near.where("df is null").drop("df").join(df, "term")
    weighed = near.where("df is not null").unionByName(rare).select("doc_id", "term", F.round(F.col("tf") * F.log(F.lit(n) / F.col("df")), 6).alias("weight"))
    return ranked(weighed, "doc_id", "term", k, "weight")


def phrase_search(index: Index, phrases: DataFrame) -> DataFrame:
    """query_id, doc_id, n_matches, first_pos: the documents that hold each phrase's tokens one after the other. phrases: query_id, text.

    The postings of a phrase's other tokens are moved only for documents that have its rarest one. Of each of those documents the sorted
    positions, each less its token's place in the phrase, are intersected, fewest first. Phrases without tokens are found nowhere.
    """
    words = phrases.select("query_id", tokens("text").alias("w")).select("query_id", F.size("w").alias("length"), F.posexplode("w").alias("place", "term"))
    rarest = Window.partitionBy("query_id").orderBy("df", "place", "term")
    known = words.join(index.terms.select("term", "df"), "term")
    first = known.withColumn("nth", F.row_number().over(rarest)).where("nth = 1").select("query_id", "term")
    docs = index.hits(first, "doc_id").select("query_id", "doc_id")
    found = index.hits(words, "doc_id", "positions")
    found = found.select("query_id", "doc_id", "length", F.struct(F.size("positions").alias("n"), F.transform("positions", lambda p: p - F.col("place")).alias("at")).alias("own"))
    rows = found.join(docs, ["query_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id").agg(F.max("length").alias("length"), F.sort_array(F.collect_list("own")).alias("parts")).where(F.size("parts") == F.col("length"))
    both = F.reduce(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["at"], lambda at, own: F.array_intersect(at, own["at"]))
    rows = rows.select("query_id", "doc_id", both.alias("at")).where(F.size("at") > 0)
    return rows.select("query_id", "doc_id", F.size("at").cast("bigint").alias("n_matches"), F.array_min("at").cast("bigint").alias("first_pos"))


def _rows(df: DataFrame) -> DataFrame:
    """vec_id, v, dim of sound vectors: those that are not null or zero and hold no null and no number that isn't finite."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(sound, F.lit(False))).select("vec_id", v.alias("v"), F.size("embedding").alias("dim"))


def _unit(table: pa.Table) -> np.ndarray:
    x = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block of data for each of asked. Both are in blocks: they have the columns dim, db and qb."""

    def best(q: pa.Table, d: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not q.num_rows or not d.num_rows:
            return empty
        qi, di, y, out = q.column("vec_id").to_numpy(), d.column("vec_id").to_numpy(), _unit(d), []
        order = np.argsort(di, kind="stable")
        di, y = di[order], y[order]
        for a in range(0, len(qi), 256):
            s = np.round(_unit(q.slice(a, 256)) @ y.T, 6)
            s[qi[a : a + 256, None] == di] = -2
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append((np.repeat(qi[a : a + 256], top.shape[1]), di[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        i, j, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": i[s > -2], "vec_id": j[s > -2], "score": s[s > -2]})

    keys = ["dim", "qb", "db"]
    data, asked = (df.select(*[F.col(c).alias(c) for c in [*keys, "vec_id", "v"]]) for df in (data, asked))  # both may come from one table
    return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")


def _blocks(data: DataFrame, asked: DataFrame, nd: Column, nq: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into nd blocks of data and nq of queries, each row to all blocks of the other side."""
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    return data.withColumn("db", block(nd, 1)).withColumn("qb", every(nq)), asked.withColumn("qb", block(nq, 2)).withColumn("db", every(nd))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, n_vectors: int | None = None, n_queries: int | None = None) -> DataFrame:
    """query_id, vec_id, score, rank by cosine in double precision, exact: blocks of queries against blocks of vectors.

    Each block keeps its k best per query, so k rows a query leave it. Vectors that are null or zero or hold null, NaN or infinite parts find
    and are found by nothing; vectors of different lengths don't find each other.
    """
    nd = -(-(vectors.count() if n_vectors is None else n_vectors) // BLOCK) or 1
    nq = -(-(queries.count() if n_queries is None else n_queries) // BLOCK) or 1
    return ranked(_best(*_blocks(_rows(vectors), _rows(queries), F.lit(nd), F.lit(nq)), k), "query_id", "vec_id", k)


class SignHash:
    """``tables`` hashes of ``bits`` signs of random orthogonal projections. A query's cells are visited by the squared projections that the changed signs cost."""

    def __init__(self, dim: int, n: int, tables: int):
        self.bits = max(1, min(16, dim, round(np.log2(max(2, n / CELL)))))
        rng = np.random.default_rng(dim)
        self.planes = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : self.bits] for _ in range(tables)]
        self.cells, self.powers = 1 << self.bits, 1 << np.arange(self.bits)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row in each table."""
        return np.stack([((x @ h > 0) @ self.powers) for h in self.planes], axis=1)

    def order(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """The first cells of each row's order."""
        p = x @ self.planes[table]
        cost = np.zeros((len(x), 1))
        for b in range(self.bits):  # by which signs are changed
            cost = np.concatenate([cost, cost + p[:, b : b + 1] ** 2], axis=1)
        first = np.argpartition(cost, min(most, self.cells) - 1, axis=1)[:, :most] if most < self.cells else np.argsort(cost, axis=1)
        first = np.take_along_axis(first, np.argsort(np.take_along_axis(cost, first, 1), axis=1, kind="stable"), 1)
        return first ^ ((p > 0) @ self.powers)[:, None]

    def visits(self, asked: np.ndarray, near: list[np.ndarray], recall: float) -> int:
        """The least number of cells to visit in each table that finds that share of the queries' true neighbours."""
        least = np.full(sum(map(len, near)), self.cells)
        for t in range(len(self.planes)):
            order, at = self.order(asked, t, self.cells), 0
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(self.cells)[None].repeat(len(asked), 0), 1)
            for i, x in enumerate(near):
                if len(x):
                    least[at : at + len(x)] = np.minimum(least[at : at + len(x)], rank[i, self.codes(x)[:, t]])
                at += len(x)
        return int(np.quantile(least, recall, method="higher")) + 1 if len(least) else self.cells


def _dealt(vectors: DataFrame, queries: DataFrame, k: int, recall: float, tables: int) -> tuple[DataFrame, DataFrame] | None:
    """Vectors of one length by table, cell and shard (db), and queries with the cells that they visit in a shard: a row for a query and a shard, not for a cell.
    A shard is a run of cells of one table, or a part of a large cell. Both are in blocks of queries (qb). None if there is nothing to visit."""
    n, dim = vectors.count(), (vectors.select("dim").first() or [0])[0]
    pilots = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOTS)
    asked = {r["vec_id"]: r["v"] for r in pilots.collect()}
    if not asked or n < 2:
        return None
    some = vectors.sparkSession.createDataFrame([(i, v) for i, v in asked.items()], "vec_id long, embedding array<double>")
    true = knn(vectors.select("vec_id", F.col("v").alias("embedding")), some, k, n, PILOTS)
    near: dict = {i: [] for i in asked}
    for r in true.select("query_id", "vec_id").join(vectors.select("vec_id", "v"), "vec_id").collect():  # k rows a pilot, or a few more where ids repeat
        near[r["query_id"]].append(r["v"])
    unit = lambda x: np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    own = SignHash(dim, n, tables)
    most = own.visits(unit(list(asked.values())), [unit(v) if v else np.zeros((0, dim)) for v in near.values()], recall)
    n_shard = min(max(BLOCK, n // SHARDS), max(BLOCK, VALUES // dim))
    nq = -(-queries.count() // max(BLOCK, VALUES // dim)) or 1

    def coded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes = own.codes(_unit(pa.Table.from_batches([part])))
                rows, table = pa.array(np.repeat(np.arange(len(codes)), tables)), np.tile(np.arange(tables), len(codes))
                yield pa.RecordBatch.from_arrays([*part.take(rows).columns, pa.array(table, pa.int32()), pa.array(codes.ravel(), pa.int64())], names=["vec_id", "v", "dim", "table", "cell"])

    data = vectors.select("vec_id", "v", "dim").mapInArrow(coded, "vec_id long, v array<double>, dim int, table int, cell long")
    sizes, lows, highs = np.zeros((tables, own.cells), np.int64), [], []
    counts = data.groupBy("table", "cell").count().toArrow()  # a row for each cell, tables * 2**16 at most
    sizes[counts.column("table").to_numpy(), counts.column("cell").to_numpy()] = counts.column("count").to_numpy()
    for one in sizes:
        ends = np.cumsum(one)
        lows.append((ends - one) // n_shard)
        highs.append(np.where(one > n_shard, (ends - 1) // n_shard, lows[-1]))
    # a small table for joins of cells with shards: cells without vectors are gone through by no one
    where = vectors.sparkSession.sparkContext.broadcast((sizes > 0, np.array(lows), np.array(highs)))

    def sharded(batches):
        _, low, high = where.value
        for batch in batches:
            table, cell, hashed = (batch.column(c).to_numpy() for c in ("table", "cell", "hashed"))
            first, last = low[table, cell], high[table, cell]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "dim", "table", "cell")), pa.array((first + hashed % (last - first + 1)).astype(np.int32))], names=["vec_id", "v", "dim", "table", "cell", "db"])

    def visiting(batches):
        there, low, high = where.value
        step = max(1, min(256, (1 << 19) // own.cells))  # so that the cells of its rows stay small
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _unit(pa.Table.from_batches([part]))
                for t in range(tables):
                    cell = own.order(x, t, most)
                    row, cell = np.repeat(np.arange(len(x)), cell.shape[1]), cell.ravel()
                    some = there[t, cell]
                    row, cell = row[some], cell[some]
                    n_shards = high[t, cell] - low[t, cell] + 1
                    nth = np.arange(n_shards.sum()) - np.repeat(np.cumsum(n_shards) - n_shards, n_shards)
                    row, cell = np.repeat(row, n_shards), np.repeat(cell, n_shards)
                    shard = low[t, cell] + nth
                    order = np.lexsort((cell, shard, row))
                    row, cell, shard = row[order], cell[order], shard[order]
                    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0))
                    bounds = np.append(new, len(row))
                    for s in range(0, len(new), 1 << 12):
                        rows = part.take(pa.array(row[new[s : s + (1 << 12)]]))
                        ends = bounds[s : s + (1 << 12) + 1]
                        lists = pa.ListArray.from_arrays(pa.array((ends - ends[0])[: len(rows) + 1], pa.int32()), pa.array(cell[ends[0] : ends[len(rows)]], pa.int32()))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), t), pa.int32()), pa.array(shard[new[s : s + (1 << 12)]], pa.int32()), lists], names=["vec_id", "v", "dim", "qb", "table", "db", "cells"])

    data = data.withColumn("hashed", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 40))).mapInArrow(sharded, "vec_id long, v array<double>, dim int, table int, cell long, db int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(nq)).cast("int")
    probes = queries.select("vec_id", "v", "dim", block.alias("qb")).mapInArrow(visiting, "vec_id long, v array<double>, dim int, qb int, table int, db int, cells array<int>")
    return data.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))), probes


def _probed(vectors: DataFrame, queries: DataFrame, k: int, recall: float, tables: int) -> tuple[DataFrame, DataFrame] | None:
    """What :func:`_dealt` gives, with a row for each query and cell."""
    dealt = _dealt(vectors, queries, k, recall, tables)
    return dealt and (dealt[0], dealt[1].withColumn("cell", F.explode(F.col("cells").cast("array<bigint>"))).drop("cells"))


def _best_in_cells(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each shard for each query, of the vectors in the cells that it visits."""

    def best(q: pa.Table, d: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and d.num_rows:
            qi, di, cell = q.column("vec_id").to_numpy(), d.column("vec_id").to_numpy(), d.column("cell").to_numpy()
            order = np.lexsort((di, cell))
            di, y = di[order], _unit(d)[order]
            codes, starts = np.unique(cell[order], return_index=True)
            ends = np.append(starts[1:], len(di))
            lists = q.column("cells").combine_chunks()
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            place = np.searchsorted(codes, lists.flatten().to_numpy())  # a shard's cells all have vectors, but those of a split one may lack some
            place[place == len(codes)] = 0
            met = codes[place] == lists.flatten().to_numpy()
            step = max(1, min(256, (1 << 22) // len(di)))
            for a in range(0, len(qi), step):
                x = _unit(q.slice(a, step))
                s = np.full((len(x), len(di)), -2.0)
                own = slice(bounds[a], bounds[a + len(x)])
                row = np.repeat(np.arange(len(x)), np.diff(bounds[a : a + len(x) + 1]))[met[own]]
                at = place[own][met[own]]
                by_cell = np.argsort(at, kind="stable")
                for rows in np.split(by_cell, np.flatnonzero(np.diff(at[by_cell])) + 1):
                    if len(rows):
                        c = slice(starts[at[rows[0]]], ends[at[rows[0]]])
                        s[row[rows], c] = x[row[rows]] @ y[c].T
                np.round(s, 6, out=s)
                s[qi[a : a + step, None] == di] = -2
                least = np.partition(s, max(0, len(di) - k), axis=1)[:, max(0, len(di) - k)]
                i, j = np.nonzero((s >= least[:, None]) & (s > -2))
                score = s[i, j]
                order = np.lexsort((di[j], -score, i))  # of equal scores those with the smallest ids
                i, j, score = i[order], j[order], score[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                out.append((qi[a : a + step][i[rank < k]], di[j[rank < k]], score[rank < k]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    keys = ["table", "dim", "qb", "db"]
    data, asked = (df.select(*[F.col(c).alias(c) for c in [*keys, "vec_id", "v", own]]) for df, own in ((data, "cell"), (asked, "cells")))
    return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")


def _lengths(vectors: DataFrame) -> list[int]:
    return sorted(r["dim"] for r in vectors.select("dim").distinct().collect())  # a row per length


def knn_lsh(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95, tables: int = 4) -> DataFrame:
    """query_id, vec_id, score, rank: approximate, by several tables of sign hashes, the best by cosine in double precision of all vectors met.

    The number of signs follows from the number of vectors, so that cells hold ``CELL`` of them, about. How many cells a query visits in each table is
    what ``PILOTS`` queries need to meet the given share of their true neighbours, which :func:`knn` finds. Cells lie in shards of bounded
    size, to each of which a query goes once, and large cells are split. Queries that find fewer than k are asked again by :func:`knn`. Odd vectors are treated as there.
    """
    rows, asked = keep(_rows(vectors), "vectors"), keep(_rows(queries), "asked")
    parts = [p for n in _lengths(rows) if (p := _dealt(rows.where(F.col("dim") == n), asked.where(F.col("dim") == n), k, recall, tables))]
    if not parts:
        return knn(vectors, queries, k)
    found = _best_in_cells(*parts[0], k)
    for more in parts[1:]:
        found = found.union(_best_in_cells(*more, k))
    found = keep(ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "query_id", "vec_id", k), "found")
    full = keep(found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id"), "full")
    short = keep(queries.join(full, queries["vec_id"] == full["query_id"], "left_anti"), "short")
    if short.isEmpty():
        return found
    return found.join(full, "query_id", "left_semi").unionByName(knn(vectors, short, k))


def fuse(lists: list[DataFrame], k: int = 10) -> DataFrame:
    """Reciprocal rank fusion: query_id, doc_id, score, rank."""
    all_ = lists[0].select("query_id", "doc_id", "rank")
    for more in lists[1:]:
        all_ = all_.unionByName(more.select("query_id", "doc_id", "rank"))
    return ranked(all_.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("score")), "query_id", "doc_id", k)


def similar_docs(terms: DataFrame, wanted: DataFrame, k: int = 3) -> DataFrame:
    """For the documents wanted: query_id, doc_id, score, rank by shared weighty terms (terms: of :func:`top_terms`).

    Blocks of queries meet blocks of documents, and k rows a query leave each, so the pairs that share a term, whose number grows with the square of the
    documents', are never shuffled. What is shuffled are the terms, times the number of the other side's blocks."""
    terms = keep(terms.select("doc_id", "term", "weight"), "terms")
    asked = terms.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    nd, nq = (-(-df.count() // TERMS) or 1 for df in (terms, asked))
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    schema = "query_id long, doc_id long, score double"

    def best(q: pa.Table, d: pa.Table) -> pa.Table:
        out, empty = [], pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not q.num_rows or not d.num_rows:
            return empty
        ids, at = np.unique(d.column("doc_id").to_numpy(), return_inverse=True)
        names = d.column("term").combine_chunks().dictionary_encode()
        own = pa.compute.index_in(q.column("term").combine_chunks(), names.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        number = names.indices.to_numpy()
        order = np.argsort(number, kind="stable")
        at, w = at[order], d.column("weight").to_numpy()[order]
        bounds = np.searchsorted(number[order], np.arange(len(names.dictionary) + 1))
        u, query = q.column("weight").to_numpy(), q.column("doc_id").to_numpy()
        known = np.flatnonzero(own >= 0)
        known = known[np.argsort(query[known], kind="stable")]
        sums, met = np.zeros(len(ids)), np.zeros(len(ids), bool)
        for run in np.split(known, np.flatnonzero(np.diff(query[known])) + 1):
            if not len(run):
                continue
            for i in run:  # a term is once in a document
                part = slice(bounds[own[i]], bounds[own[i] + 1])
                sums[at[part]] += u[i] * w[part]
                met[at[part]] = True
            me = query[run[0]]
            place = np.searchsorted(ids, me)
            if place < len(ids) and ids[place] == me:
                met[place] = False
            found = np.flatnonzero(met)
            score = np.floor(sums[found] * 1e4 + 0.5)
            if len(found) > k:  # the k best, and of equal ones those with the smallest ids
                low = np.partition(score, len(score) - k)[len(score) - k]
                over = score > low
                stay = np.concatenate([np.flatnonzero(over), np.flatnonzero(score == low)[: k - over.sum()]])
                found = found[stay]
            out.append((np.full(len(found), me), ids[found], sums[found]))
            sums[:], met[:] = 0, False
        if not out:
            return empty
        return pa.table(dict(zip(("query_id", "doc_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    left, right = asked.withColumn("qb", block(nq)).withColumn("db", every(nd)), terms.withColumn("db", block(nd)).withColumn("qb", every(nq))
    left, right = (df.select(*[F.col(c).alias(c) for c in ("qb", "db", "doc_id", "term", "weight")]) for df in (left, right))  # both come from one table
    found = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(best, schema)
    return ranked(found.withColumn("score", F.round("score", 4)), "query_id", "doc_id", k)


def evaluate(hits: DataFrame, relevant: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """k, recall (over relevant pairs) and mrr (over queries that have any)."""
    found = relevant.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    first = found.groupBy("query_id").agg(F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)).alias("rr"), F.count(F.lit(1)).alias("n"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"n{k}") for k in ks])
    one = first.agg(F.avg("rr").alias("mrr"), F.sum("n").alias("n"), *[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in ks])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.round(F.col(f"n{k}") / F.col("n"), 6).alias("recall"), F.round("mrr", 6).alias("mrr")) for k in ks])))
