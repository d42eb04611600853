"""SimHash near-duplicates: exact pairs of fingerprints within a few bits, by vantage-point trees.

Each distinct fingerprint is looked at in four quarters of 16 bits. If two differ in at most four bits, some
quarter differs in at most one. Each quarter has a vantage-point tree over its 65,536 values: a node
splits its values at the median Hamming distance from a vantage value, and a fingerprint, which lives in one
leaf, also visits those leaves that the triangle bound |d(q, vantage) - d(x, vantage)| <= d(q, x) doesn't rule
out. (On all 64 bits such trees prune next to nothing, as distances crowd around 32.) The tree deepens with
the number of fingerprints, so that a leaf, one shard, stays about the same size. In a shard, values within one
bit are compared in full; where too many share them, they are split by a second quarter: if all but
one quarter differed in two bits, six would differ in all.

A shard returns a spanning forest of its links, not the links, and connected components join the shards.
Copies share a fingerprint and enter once.

Null and blank texts have fingerprint zero, linked like any other. Null ids are not counted as smallest; a group of
null ids alone has a null component_id. Rows that repeat an id or text each get a row; an empty table gives an
empty result. :func:`drop_near` passes other columns through.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, fresh, small
from .components import components, spanning

QUARTERS, BITS = 4, 16
#: Fingerprints in a leaf, about; pairs compared at once; pairs from which a second quarter splits them.
LEAF, BLOCK, SPLIT = 4096, 1 << 21, 1 << 23
_MASKS = np.array([0, *(1 << i for i in range(BITS))], np.uint64)
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned. bytes.lower() and bytes.split() know A-Z and the blanks 09-0D and 20 alone."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    n = max(1, len(words) - width + 1)
    bounds = zip(starts[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist(), strict=True)
    return of_hashes(np.array([digest(line[a:b], 42) for a, b in bounds], "<u8"))


def of_hashes(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    h = hashes.view(np.uint8).reshape(-1, 8)
    set_ = np.concatenate([np.bincount(h[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)])
    return int(np.packbits(set_ * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """<id_col>, fp: the fingerprint as a signed long."""

    def each(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary"))
    return rows.mapInArrow(each, f"{id_col} long, fp long")


def tree(depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaf of each value, and the other leaves that a value visits with radius 1, as starts and leaves."""
    home, visits = np.zeros(1 << BITS, np.int64), []
    values = np.arange(1 << BITS, dtype=np.uint16)
    level = [(values, values)]
    for step in range(depth):
        below = []
        for members, guests in level:
            vantage = members[(len(members) * 40503 + step) % len(members)]
            d = np.bitwise_count(members ^ vantage).astype(int)
            cut = int(np.sort(d)[(len(d) - 1) // 2])  # inner: up to cut
            if len(d) < 2 or d.max() == cut:
                cut -= 1
            g = np.bitwise_count(guests ^ vantage).astype(int)
            for inside, over in ((d <= cut, g - 1 <= cut), (d > cut, g + 1 > cut)):
                if inside.any():
                    below.append((members[inside], guests[over]))
        level = below
    for leaf, (members, guests) in enumerate(level):
        home[members] = leaf
    for leaf, (members, guests) in enumerate(level):
        away = guests[home[guests] < leaf]  # the leaf of the larger number sees a pair that two leaves share
        visits.append(np.column_stack([away.astype(np.int64), np.full(len(away), leaf)]))
    visits = np.concatenate(visits)
    visits = visits[np.lexsort((visits[:, 1], visits[:, 0]))]
    return home, np.searchsorted(visits[:, 0], np.arange((1 << BITS) + 1)), visits[:, 1]


def links(members: np.ndarray, guests: np.ndarray, quarter: int, bits: int, found) -> None:
    """Calls found(i, j) with places, guests after members, of pairs whose quarter differs in one bit at most."""
    both = np.concatenate([members, guests])
    _near(both, np.arange(len(members)), np.arange(len(both)), [quarter], bits, found)


def _near(fps, left, right, quarters, bits, found):
    """Pairs of a place in left and a larger one in right that are near in the last of quarters."""
    value = lambda at: (fps[at] >> np.uint64(BITS * quarters[-1])) & np.uint64(0xFFFF)
    left = left[np.argsort(value(left), kind="stable")]
    keys, starts, counts = np.unique(value(left), return_index=True, return_counts=True)
    place = np.full(1 << BITS, -1)
    place[keys] = np.arange(len(keys))
    right = right[np.argsort(value(right), kind="stable")]
    rkeys, rstarts, rcounts = np.unique(value(right), return_index=True, return_counts=True)
    for mask in _MASKS:
        group = place[rkeys ^ mask]
        there = np.flatnonzero(group >= 0)
        g = group[there]
        pairs = rcounts[there] * counts[g]
        for k in np.flatnonzero(pairs > SPLIT):  # many on both sides
            a, b = left[starts[g[k]] :][: counts[g[k]]], right[rstarts[there[k]] :][: rcounts[there[k]]]
            more = [q for q in range(QUARTERS) if q not in quarters]
            if len(quarters) == 1:
                for q in more:
                    _near(fps, a, b, [*quarters, q], bits, found)
            else:
                step = max(1, BLOCK // len(a))
                for i in range(0, len(b), step):
                    part = b[i : i + step]
                    _compare(fps, np.tile(a, len(part)), np.repeat(part, len(a)), bits, found)
        small = pairs <= SPLIT
        there, g, pairs = there[small], g[small], pairs[small]
        cuts = np.flatnonzero(np.diff(np.cumsum(pairs) // BLOCK, prepend=0))
        for at in np.split(np.arange(len(pairs)), cuts):
            total = pairs[at]
            if not total.sum():
                continue
            k = np.repeat(at, total)
            nth = np.arange(len(k)) - np.repeat(np.cumsum(total) - total, total)
            _compare(fps, left[starts[g[k]] + nth % counts[g[k]]], right[rstarts[there[k]] + nth // counts[g[k]]], bits, found)


def _compare(fps, a, b, bits, found):
    near = (a < b) & (np.bitwise_count(fps[a] ^ fps[b]) <= bits)
    if near.any():
        found(a[near], b[near])


def _forest(bits: int):
    def shard(table: pa.Table) -> pa.Table:
        fps, guest = table.column("fp").to_numpy().view(np.uint64), table.column("guest").to_numpy().astype(bool)
        fps = np.concatenate([fps[~guest], fps[guest]])
        quarter = int(table.column("shard")[0].as_py()) >> BITS
        state = [np.arange(len(fps))]

        def found(a, b):
            state[0] = spanning(len(fps), a, b, state[0])

        links(fps[: int((~guest).sum())], fps[int((~guest).sum()) :], quarter, bits, found)
        own = np.flatnonzero(state[0] != np.arange(len(fps)))
        return pa.table({"a": fps[own].view(np.int64), "b": fps[state[0][own]].view(np.int64)})

    return shard


def groups(prints: DataFrame, id_col: str = "doc_id", bits: int = 4) -> DataFrame:
    """prints (<id_col>, fp) with component_id. bits: at most 4, which is what quarters can promise."""
    if not 0 <= bits <= 4:
        raise ValueError("bits must be from 0 to 4")
    prints = freeze(prints, "prints")
    unique = freeze(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "unique")
    linked = freeze(components(near_prints(unique, bits)), "linked")
    first = linked.join(unique, linked["node"] == unique["fp"]).groupBy("component").agg(F.min("first_id").alias("least"))
    linked = freeze(linked.join(first, "component").select(F.col("node").alias("fp"), "least"), "least")
    of_print = freeze(unique.join(linked, "fp", "left").select("fp", F.coalesce("least", "first_id").alias("component_id")), "of_print")
    return prints.join(of_print, "fp").select(id_col, "fp", "component_id")


def near_prints(unique: DataFrame, bits: int = 4) -> DataFrame:
    """a, b: links of different fingerprints (fp, each once) within so many bits, a spanning forest of each shard's."""
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, unique.count()) / LEAF))))

    def route(batches):
        home, starts, leaves = tree(depth)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for q in range(QUARTERS):
                value = ((fp.view(np.uint64) >> np.uint64(BITS * q)) & np.uint64(0xFFFF)).astype(np.int64)
                n = starts[value + 1] - starts[value]
                away = leaves[np.repeat(starts[value] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                shard = np.concatenate([home[value], away]) + (q << BITS)
                guest = np.arange(len(shard)) >= len(fp)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.concatenate([fp, np.repeat(fp, n)])), pa.array(guest)], names=["shard", "fp", "guest"])

    routed = unique.select("fp").mapInArrow(route, "shard int, fp long, guest boolean")
    return routed.groupBy("shard").applyInArrow(_forest(bits), "a long, b long")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest id, or the first where ids repeat or are null."""
    own, unclear = id_col, not docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty()
    if unclear:
        own = fresh(docs, "__row")[0]
        docs = freeze(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    kept = groups(fingerprints(docs, own, text_col, width), own, bits).where(F.col(own) == F.col("component_id"))
    name = fresh(docs, "__kept")[0]
    kept = freeze(kept.select(F.col(own).alias(name)), "kept")
    return docs.join(small(kept), docs[own] == F.col(name), "left_semi").select(*[c for c in docs.columns if c != own or not unclear])
