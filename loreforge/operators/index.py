"""The text index: chunks, postings and their statistics."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens, with_array
from ..sources.tables import drop, keep, shared


def chunk(documents: DataFrame, size: int = 250, step: int = 200) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = with_array(documents.select("doc_id", "text"), "w", words).where(F.size("w") > 0)
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - 1) / step), F.lit(0)).cast("int"))).alias("chunk_no"))
    part = F.slice("w", F.col("chunk_no") * step + 1, size)
    return rows.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.size(part).cast("bigint").alias("n_tokens"), F.array_join(part, " ").alias("text"))


def _by_document(documents: DataFrame) -> DataFrame:
    """doc_id, text, dealt by doc_id: texts move once, so that tokens are counted where they are and none is shuffled."""
    return documents.select("doc_id", "text").repartition("doc_id")


def postings(documents: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions. A document's postings are gathered in its own group."""
    each = _by_document(documents).select("doc_id", F.posexplode(tokens("text")).alias("pos", "term"))
    return each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def counts(documents: DataFrame) -> DataFrame:
    """term, doc_id, tf: postings without positions."""
    return _by_document(documents).select("doc_id", F.explode(tokens("text")).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: n, mean_length. Documents without tokens count."""
    return documents.select(F.size(tokens("text")).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean_length"))


#: Postings of a bucket, about, and of one term in a shard; terms of more shards than one that each task gets, at most.
BUCKET, SHARD, HOT = 1 << 18, 1 << 20, 1 << 19
#: Tokens that a task gathers by term before it gives them to the shuffle, about.
PACK = 1 << 21
_POSTINGS = "slot bigint, term string, doc_id bigint, tf bigint, dl bigint, positions array<int>"
_TERMS = "term string, df bigint, cf bigint, shards int, number bigint"


class Index:
    """A stored index: what searches read in place of documents. It survives its session: ``Index(spark, path)`` opens what :func:`write_index` wrote.

    postings (slot, term, doc_id, tf, dl, positions) are bucketed and sorted by slot, the hash of a term and a shard of it, terms (term, df, cf,
    shards, number) by term. So joins with query terms shuffle the queries alone, a few terms' lookup reads their buckets alone, and a term of more
    than ``SHARD`` documents lies in several buckets. dl is the document's length. n and mean_length count documents without tokens, too.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        totals = spark.read.parquet(f"{path}/totals").first()
        self.n, self.mean_length, self.buckets = totals["n"], totals["mean_length"], totals["buckets"]
        self.postings = self._bucketed("postings", _POSTINGS, "slot")
        self.terms = self._bucketed("terms", _TERMS, "term")

    def _bucketed(self, what: str, schema: str, by: str) -> DataFrame:
        name, at = _table(self.path, what), f"{self.path}/{what}".replace("'", "")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        return self.spark.table(name)

    def of(self, terms: DataFrame) -> DataFrame:
        """terms (term and others) with their df and cf, and a row for each slot of theirs. Terms that no document has are left out."""
        return terms.join(self.terms, "term").withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda i: _slot(F.col("term"), i)))).drop("shards")

    def hits(self, terms: DataFrame, *columns: str) -> DataFrame:
        """The postings of terms (term and others), with the given columns of postings."""
        asked = self.of(terms).withColumnRenamed("slot", "own_slot").withColumnRenamed("term", "own_term")
        # the terms are compared by two bounds, as a second equal column would make Spark shuffle the postings
        same = (F.col("slot") == F.col("own_slot")) & (F.col("term") <= F.col("own_term")) & (F.col("term") >= F.col("own_term"))
        return self.postings.select("slot", "term", *columns).join(asked, same).drop("own_slot", "own_term")

    def lookup(self, terms: list[str]) -> DataFrame:
        """Postings of a few terms: reads their buckets alone."""
        slots = [r["slot"] for r in self.of(self.spark.createDataFrame([(t,) for t in set(terms)], "term string")).select("slot").collect()] if terms else []
        return self.postings.where(F.col("slot").isin(slots) & F.col("term").isin(terms)).drop("slot")


def _table(path: str, what: str) -> str:
    return f"index_{hashlib.md5(path.encode()).hexdigest()}_{what}"


def _slot(term: Column, shard: Column) -> Column:
    return F.xxhash64(term, shard)


def _shards(rows: DataFrame, n: int) -> DataFrame:
    """term, shards of the terms that more than SHARD of the n documents have, HOT of them at most. Shards only say where postings lie."""
    most, none = SHARD, rows.sparkSession.createDataFrame([], "term string, shards int")
    if n <= most:
        return none
    often = keep(rows.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > most), "often")
    while often.where(F.col("df") > most).count() > HOT:
        most *= 4
    return often.where(F.col("df") > most).select("term", F.ceil(F.col("df") / most).cast("int").alias("shards"))


def _packed(rows: DataFrame, hot: dict[str, int]) -> DataFrame:
    """term, shard, docs, dls, tfs, positions: postings of many documents in one row for each term and shard. rows: doc_id (each once), dl, hash, w."""
    spread = rows.sparkSession.sparkContext.broadcast(hot)

    def packed(parts: list) -> pa.RecordBatch:
        lists = [b.column(3) for b in parts]
        doc, dl, mixed = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(3))
        n = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
        coded = pa.chunked_array([x.flatten() for x in lists], pa.string()).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        code, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        shard = np.zeros(len(code), np.int64)
        if spread.value:
            shards = np.array([spread.value.get(t, 1) for t in coded.dictionary.to_pylist()], np.int64)
            shard = mixed[owner] % shards[code]
        order = np.lexsort((shard, code)) if shard.any() else np.argsort(code, kind="stable")  # documents and positions are in order
        code, owner, pos, shard = code[order], owner[order], pos[order], shard[order]
        new_row = np.ones(len(code), bool)
        new_row[1:] = (np.diff(code) != 0) | (np.diff(shard) != 0)
        new = new_row.copy()
        new[1:] |= np.diff(owner) != 0
        at, rows_at = np.flatnonzero(new), np.flatnonzero(new_row)
        own, places = owner[at], np.append(np.searchsorted(at, rows_at), len(at)).astype(np.int32)
        of = lambda values, kind, bounds=places: pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(code[rows_at])), pa.array(shard[rows_at], pa.int32()), of(doc[own], pa.int64()), of(dl[own], pa.int32()), of(np.diff(at, append=len(code)), pa.int32()), of(pos, pa.int32(), np.append(rows_at, len(code)).astype(np.int32))],
            names=["term", "shard", "docs", "dls", "tfs", "positions"],
        )

    def each(batches):
        parts, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                parts.append(part)
                size += len(part.column(3).flatten())
                if size >= PACK:
                    yield packed(parts)
                    parts, size = [], 0
        if size:
            yield packed(parts)

    return rows.select("doc_id", "dl", "hash", "w").mapInArrow(each, "term string, shard int, docs array<bigint>, dls array<int>, tfs array<int>, positions array<int>")


def _unpacked(rows: DataFrame) -> DataFrame:
    """slot, term, doc_id, tf, dl, positions of what :func:`_packed` made, with its slot."""

    def each(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                docs, dls, tfs, positions = (part.column(i) for i in range(2, 6))
                row, tf = pa.array(np.repeat(np.arange(len(part)), np.diff(docs.offsets.to_numpy()))), tfs.flatten()
                bounds = np.append(0, np.cumsum(tf.to_numpy(), dtype=np.int32)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), docs.flatten(), tf.cast(pa.int64()), dls.flatten().cast(pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), positions.flatten())], names=["slot", "term", "doc_id", "tf", "dl", "positions"])

    return rows.select("slot", "term", "docs", "dls", "tfs", "positions").mapInArrow(each, _POSTINGS)


def write_index(documents: DataFrame, path: str | None = None, buckets: int | None = None) -> Index:
    """A task gathers its documents' postings by term, so that not tokens but lists of postings are shuffled. Rows that repeat a doc_id are one document whose
    length and counts add up and whose positions are those in each text; rows without a doc_id are left out."""
    spark, path = documents.sparkSession, path or shared(documents.sparkSession, "index")
    rows = documents.where("doc_id is not null").select("doc_id", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("w"))
    lengths = keep(rows.select("doc_id", F.size("w").alias("size")).groupBy("doc_id").agg(F.sum("size").alias("dl"), F.count(F.lit(1)).alias("times")), "lengths")
    repeated = keep(lengths.where("times > 1").select("doc_id", F.col("dl").alias("whole")), "repeated")
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean_length"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    buckets = buckets or min(100_000, -(-totals["tokens"] // BUCKET) or 1)
    hot = {r["term"]: r["shards"] for r in _shards(rows, totals["n"]).collect()}  # HOT rows at most
    again = not repeated.isEmpty()
    whole = with_array(documents.where("doc_id is not null").select("doc_id", "text"), "w", F.coalesce(tokens("text"), F.array().cast("array<string>"))).drop("text")
    once = whole.join(repeated, "doc_id", "left_anti") if again else whole
    once = once.select("doc_id", F.size("w").cast("long").alias("dl"), F.xxhash64("doc_id").alias("hash"), "w")
    lists = _packed(once, hot).select(_slot(F.col("term"), F.col("shard")).alias("slot"), "*")
    found = _unpacked(lists.repartition(buckets, "slot"))
    if again:
        spread = F.broadcast(spark.createDataFrame(list(hot.items()), "term string, shards int"))
        own = whole.join(repeated, "doc_id").select("doc_id", F.col("whole").alias("dl"), F.posexplode("w").alias("pos", "term")).join(spread, "term", "left")
        own = own.select(_slot(F.col("term"), F.pmod(F.xxhash64("doc_id"), F.coalesce("shards", F.lit(1))).cast("int")).alias("slot"), "term", "doc_id", "dl", "pos").repartition(buckets, "slot")
        own = own.groupBy("slot", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions"))
        found = found.unionByName(own)
    found.write.bucketBy(buckets, "slot").sortBy("slot", "term", "doc_id").option("path", f"{path}/postings").mode("overwrite").saveAsTable(_table(path, "postings"))
    terms = spark.table(_table(path, "postings")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    terms = terms.join(F.broadcast(spark.createDataFrame(list(hot.items()), "term string, shards int")), "term", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    terms = terms.repartition(buckets, "term").withColumn("number", F.monotonically_increasing_id())
    terms.write.bucketBy(buckets, "term").sortBy("term").option("path", f"{path}/terms").mode("overwrite").saveAsTable(_table(path, "terms"))
    spark.createDataFrame([(totals["n"], totals["mean_length"], buckets)], "n long, mean_length double, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    for kept in (lengths, repeated):
        drop(kept)
    return Index(spark, path)
