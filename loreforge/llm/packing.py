"""Best-two-fit packing of documents' tokens into sequences of equal capacity.

A document that is longer than a sequence is cut into full pieces after a first one that may be shorter. A bin
is filled greedily with the longest pieces that fit; then its smallest piece is put back if two unpacked
pieces fill the expanded gap more tightly (Friesen and Langston 1991).

What the algorithm does depends on the pieces' lengths alone, so the plan is made from the number of pieces of
each length: at most ``capacity`` numbers, however large the corpus. A bin's pattern is repeated as often as
the lengths it uses last, which gives the bins of the one-by-one algorithm. Each task that cuts texts numbers its pieces
of each length; the numbers of pieces of each length that earlier tasks have are summed up and added, and each piece
takes the slot of its number. So the ids are written once and needn't move again, nor go through Python.

Null texts count as empty and hold the end id alone; an empty table gives an empty result; rows that repeat
an id are packed each; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze, in_arrow, slices, small
from .subwords import crc, encoder


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins for counts[length] pieces of each length: (lengths in a bin, how many such bins)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while left.any():
        there = np.flatnonzero(left)
        used, room = [], capacity
        while room:
            fits = there[: np.searchsorted(there, room, "right")]
            if not len(fits):
                break
            longest = int(fits[-1])
            take = min(room // longest, int(left[longest]))
            used += [longest] * take
            room -= longest * take
            left[longest] -= take
            there = np.flatnonzero(left[: room + 1])
        if len(used) > 1 and room:
            two = _two(left, room + used[-1])
            if sum(two) > used[-1]:
                left[used.pop()] += 1
                left[two[0]] -= 1
                left[two[1]] -= 1
                used += two
        lengths, each = np.unique(used, return_counts=True)
        more = int(((left[lengths]) // each).min())
        left[lengths] -= more * each
        bins.append((used, 1 + more))
    return bins


def _two(left: np.ndarray, gap: int) -> list[int]:
    """The two unpacked lengths with the largest sum within gap; of equal sums those with the longest piece."""
    there = np.flatnonzero(left[:gap])
    if not len(there):
        return [0, 0]
    other = np.searchsorted(there, np.minimum(gap - there, there), "right") - 1
    alone = (other >= 0) & (there[other] == there) & (left[there] < 2)
    other = other - alone
    sums = np.where(other >= 0, there + there[other], 0)
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return [int(there[best]), int(there[other[best]])] if sums[best] else [0, 0]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """<id_col>, piece, start, length, ids_crc32, part (the task), nth (of the task's pieces of that length) and, if asked for, ids (little-endian, as wide as the tokenizer needs)."""

    def cut(batches):
        from pyspark import TaskContext

        coder, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], coder.dtype)
        for batch in slices(batches):
            rows, ids_of = [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end])
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, crc(ids[a:b]), part, seen[b - a]))
                    seen[b - a] += 1
                    if with_ids:
                        ids_of.append(ids[a:b].tobytes())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids_of, pa.binary())] * with_ids, names=[id_col, "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return in_arrow(rows, cut, f"{id_col} long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces, each with its sequence_id and its offset there."""
    found = freeze(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # capacity rows at most
    slots, base = [], 0
    for used, n in plan(counts, capacity):
        offset = 0
        for length in used:
            slots.append((length, n, base, offset))
            offset += length
        base += n
    by_length: dict[int, np.ndarray] = {}
    for length in counts:
        own = np.array([s[1:] for s in slots if s[0] == length], np.int64)
        by_length[length] = np.column_stack([np.cumsum(own[:, 0]) - own[:, 0], own[:, 1:]])  # first number, first sequence, offset

    sizes = found.groupBy("length", "part").count()
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = freeze(sizes.select("length", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead")), "ahead")
    numbered = found.join(small(sizes), ["length", "part"]).withColumn("number", F.col("ahead") + F.col("nth")).drop("ahead", "part", "nth")

    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        length, number = lengths.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for value in np.unique(length):
            at, own = length == value, by_length[int(value)]
            slot = own[np.searchsorted(own[:, 0], number[at], "right") - 1]
            sequence[at], offset[at] = slot[:, 1] + number[at] - slot[:, 0], slot[:, 2]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    kept = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return numbered.select(*kept, place("length", "number").alias("place")).select(*kept, "place.sequence_id", "place.offset")


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence: its ids in order, and which document lies where. A group holds one sequence."""
    part = F.sort_array(F.collect_list(F.struct("offset", "length", id_col, "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(part.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: F.struct(p["offset"], p["length"], p[id_col], p["piece"])).alias("parts"))
