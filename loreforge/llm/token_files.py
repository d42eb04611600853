"""Token ids in Arrow stream files: fixed-size-list batches of equal-length sequences and their masks.

Documents are dealt into ranges of doc_id, and a task writes its range as shards: a file of sequences and a file that
tells where its documents start. A shard that has reached ``SHARD`` ids is closed at the end of its document, and the next
one begins. A shard's ids run on over sequence borders; only its last sequence is padded, with mask false. All batches
but the last hold the same number of sequences, so a sequence's batch follows from its number, and a memory-mapped shard
gives ids and masks without copying them.

A task that runs again writes new files; the manifest, which Spark commits, lists the files of those
that counted. It has one row per shard and stays a table: what lies ahead of each shard is summed up over ranges of
its rows. Files are read back a batch at a time, wherever they lie.

Null texts count as empty; null ids come first; rows that repeat an id (or have none) are all kept, side by side, in
the order of their texts' hashes, by which ranges part them, too; only equal rows share a range. An empty
table gives a manifest without documents. Other columns are not read.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, new_path, slices
from .mixing import running
from .subwords import encoder

#: Ids in a sequence, sequences in a batch, and ids of a shard from which the next one begins.
LENGTH, ROWS, SHARD = 1024, 64, 1 << 26
#: task: a range's place among all; part: a shard's place in its range.
MANIFEST = "task int, part int, tokens string, docs string, n_docs long, n_ids long"


def open_fs(uri: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri.removeprefix("file:").replace("///", "/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, folder: str, dtype, length: int = LENGTH, rows: int = ROWS):
        self.fs, at = open_fs(folder)
        self.fs.create_dir(at, recursive=True)
        name = f"{at}/{uuid.uuid4().hex}"
        self.paths, self.length, self.rows, self.dtype = (f"{name}.tokens.arrow", f"{name}.docs.arrow"), length, rows, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.fs.open_output_stream(p) for p in self.paths]
        self.out = pa.ipc.new_stream(self.files[0], self.schema)
        self.docs = pa.ipc.new_stream(self.files[1], self.index)
        self.held, self.n_held, self.n_ids, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = self.n_ids + np.cumsum(lengths) - lengths
        self.docs.write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(lengths)], schema=self.index))
        self.held += ids
        self.n_held += int(lengths.sum())
        self.n_ids += int(lengths.sum())
        self.n_docs += len(ids)
        whole = self.length * self.rows
        if self.n_held >= whole:
            flat = np.concatenate(self.held)
            keep = len(flat) // whole * whole
            for i in range(0, keep, whole):
                self._write(flat[i : i + whole], whole)
            self.held, self.n_held = [flat[keep:]], len(flat) - keep

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        for x in (self.out, self.docs, *self.files):
            x.close()


class Shard:
    """A shard's sequences, masks and documents; views of the mapped file where no border is crossed."""

    def __init__(self, tokens: str, docs: str):
        self.batches = [(b.column(0).flatten(), b.column(1)) for b in _batches(tokens)]
        self.index = [b for b in _batches(docs)]
        self.flat = [ids.to_numpy(zero_copy_only=True) for ids, _ in self.batches]
        self.length = self.batches[0][1].type.list_size if self.batches else LENGTH
        self.per_batch = len(self.flat[0]) if self.flat else 0

    def sequence(self, i: int) -> np.ndarray:
        k, at = divmod(i * self.length, self.per_batch)
        return self.flat[k][at : at + self.length]

    def mask(self, i: int) -> pa.Array:
        k, at = divmod(i, self.per_batch // self.length)
        return self.batches[k][1][at].values

    def ids(self, start: int, n: int) -> np.ndarray:
        parts, at = [], start
        while at < start + n:
            k, place = divmod(at, self.per_batch)
            parts.append(self.flat[k][place : place + start + n - at])
            at += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _batches(path: str):
    filesystem, at = open_fs(path)
    source = pa.memory_map(at) if path.startswith("file:") else filesystem.open_input_file(at)
    return list(pa.ipc.open_stream(source))


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shard_ids: int = SHARD) -> DataFrame:
    """Writes docs' token files into folder, a new one in the shared folder by default; the manifest."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    schema = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("tokens", pa.string()), ("docs", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def shards(batches):
        from pyspark import TaskContext

        coder, out, part = encoder(tokenizer), None, 0
        end = np.array([end_id], coder.dtype)

        def closed():
            out.close()
            paths = [f"file:{p}" if folder.startswith("file:") else f"{folder}/{p.rpartition('/')[2]}" for p in out.paths]
            return pa.RecordBatch.from_pylist([{"task": TaskContext.get().partitionId(), "part": part, "tokens": paths[0], "docs": paths[1], "n_docs": out.n_docs, "n_ids": out.n_ids}], schema)

        for batch in slices(batches):
            ids = [np.concatenate([x, end]) for x in coder.encode(batch.column(1).to_pylist())]
            at, ends = 0, np.cumsum([len(x) for x in ids])
            while at < len(ids):
                out = out or ShardWriter(folder, coder.dtype)
                room = shard_ids - out.n_ids + (ends[at - 1] if at else 0)
                upto = min(len(ids), int(np.searchsorted(ends, room)) + 1)  # with the document that fills it
                out.add(batch.column(0).slice(at, upto - at), ids[at:upto])
                at = upto
                if out.n_ids >= shard_ids:
                    yield closed()
                    out, part = None, part + 1
        if out:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").select("id", "text")
    return freeze(dealt.mapInArrow(shards, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32, with start over all shards."""
    placed = running(manifest.select("task", "part", "tokens", "docs", "n_ids"), ["task", "part"], base="n_ids")
    shards = placed.select("tokens", "docs", "base")

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                digests = _digests(r["tokens"])
                next(digests)
                for index in _stream(r["docs"]):
                    starts, lengths = index.column(1).to_numpy(), index.column(2)
                    crcs = [digests.send(n) for n in lengths.to_pylist()]
                    yield pa.record_batch([index.column(0), pa.array(starts + r["base"]), lengths, pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(max(1, manifest.count())).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _stream(path: str):
    """Batches of a file, one at a time."""
    filesystem, at = open_fs(path)
    with filesystem.open_input_stream(at) as source:
        yield from pa.ipc.open_stream(source)


def _digests(path: str):
    """Is sent the lengths of a shard's documents in order and answers with the crc32 of each one's ids."""
    held, value = np.zeros(0, "<u4"), None
    batches = (b.column(0).flatten().to_numpy().astype("<u4") for b in _stream(path))
    while True:
        left = yield value
        value = 0
        while left:
            if not len(held):
                held = next(batches)
            value = zlib.crc32(held[:left], value)
            left, held = left - len(held[:left]), held[left:]
