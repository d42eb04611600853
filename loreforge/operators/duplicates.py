"""Duplicates and contamination. Copies are folded into classes first, so no group of copies is expanded into pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line, shingles, with_array
from ..sources.tables import keep

#: Cells into which shingles fall by their hashes, for the order of rare ones.
CELLS = 1 << 18
#: Shingles and pairs of a group of sets that one task compares, about; texts that a task remembers in order to pass over their copies.
BLOCK, PAIRS, SEEN = 1 << 22, 1 << 16, 1 << 20


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """digest, n_docs, first_id: texts that several documents have. Texts are told apart by two digests, of 128 and of 256 bits."""
    groups = documents.groupBy(F.md5("text").alias("digest"), F.sha2("text", 256).alias("more")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id"))
    return groups.where("n_docs > 1").drop("more")


def _lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", line("text").alias("line"))


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size: a row per document. Documents with the same tokens are one class, named by its smallest id; those without tokens, too."""
    lines = _lines(documents).withColumn("digest", F.sha2("line", 256))
    sizes = lines.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return lines.select("doc_id", "digest").join(sizes, "digest").select("doc_id", "class_id", "class_size")


def shingle_sets(documents: DataFrame, n: int = 5) -> DataFrame:
    """class_id, members, grams: one row per class of documents with the same tokens; the smallest id names it. A shorter text is one shingle, an empty one none."""
    found = _lines(documents).where("line <> ''").groupBy("line").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    grams = F.when(F.size("w") < n, F.array("line")).otherwise(F.array_distinct(shingles("w", n)))
    return with_array(found, "w", F.split("line", " ")).select("class_id", "members", grams.alias("grams"))


def near_duplicate_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_links: a row per document, with the number of other classes that are near its own. Pairs are counted where they are found and not kept."""
    scan, sets, pairs = _near(documents, 5, 0.8)
    links = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    named = sets.join(links, "key", "left").select("digest", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return scan.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "class_size", "n_links")


def document_clusters(documents: DataFrame, n: int = 5, t: float = 0.8) -> DataFrame:
    """node, cluster: every document that has a copy or is near another, and the smallest id that it reaches. Of a large family of near copies about one pair a text is verified."""
    sets = hashed_sets(documents, n)
    labels = duplicate_clusters(spanning_links(rare_grams(sets, t), sets, t)).withColumnRenamed("node", "class_id")
    found = classes(documents).join(labels, "class_id", "left").where("class_size > 1 or cluster is not null")
    return found.select(F.col("doc_id").alias("node"), F.coalesce("cluster", "class_id").alias("cluster"))


def hashed_sets(documents: DataFrame, n: int = 5) -> DataFrame:
    """class_id, grams, n: the 64-bit hashes of the shingles of :func:`shingle_sets`, each once, kept."""

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [hashes(line, n) for line in part.column("line").to_pylist()]
                sizes = np.fromiter(map(len, sets), np.int32, len(sets))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("class_id"), lists, pa.array(sizes)], names=["class_id", "grams", "n"])

    found = _lines(documents).where("line <> ''").groupBy("line").agg(F.min("doc_id").alias("class_id"))
    return keep(found.select("class_id", F.col("line").cast("binary").alias("line")).mapInArrow(each, "class_id long, grams array<long>, n int"), "sets")


def hashes(line: bytes, n: int) -> np.ndarray:
    """Spark's xxhash64 of a text's shingles, each once. line: its tokens, space-joined."""
    import xxhash

    words, digest = line.split(b" "), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(line, 42)], np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    bounds = zip([0, *ends[:-n].tolist()], (ends[n - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.array([digest(line[a:b], 42) for a, b in bounds], np.uint64)).view(np.int64)


def _cells(sets: DataFrame) -> np.ndarray:
    """How many of the sets' shingles fall into each of ``CELLS`` cells. Each task gives its counts once."""

    def counted(batches):
        own = np.zeros(CELLS, np.int64)
        for batch in batches:
            own += _by_cell(batch.column(0).flatten().to_numpy())
        for k, part in enumerate(np.array_split(own, 16)):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], names=["k", "counts"])

    return _summed(sets.select("grams").mapInArrow(counted, "k long, counts binary"))


def _by_cell(grams: np.ndarray) -> np.ndarray:
    return np.bincount(grams & (CELLS - 1), minlength=CELLS)


def _summed(parts: DataFrame) -> np.ndarray:
    """The tasks' counts (k, counts) of 16 runs of cells, added up."""

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // 16, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_py(), np.int64)
        return pa.table({"k": table.column("k").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = parts.groupBy("k").applyInArrow(added, "k long, counts binary").collect()  # 16 rows
    return np.concatenate([np.zeros(CELLS, np.int64)] if not rows else [np.frombuffer(r["counts"], np.int64) for r in sorted(rows)])


def _rarest(grams: np.ndarray, n: np.ndarray, cells: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of n shingles each, set, shingle and place of the size - ceil(t * size) + 1 rarest, in their order. The order is by how many shingles fall into a shingle's cell."""
    row, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    order = np.lexsort((grams, cells[grams & (CELLS - 1)], row))
    place = np.arange(len(row)) - np.repeat(starts, n)
    chosen = place < (n - np.ceil(n * t - 1e-9).astype(np.int64) + 1)[row]
    return row[chosen], grams[order[chosen]], place[chosen]  # sets stay in order


def rare_grams(sets: DataFrame, t: float) -> DataFrame:
    """class_id, n, gram, kept: of each set those of the size - ceil(t * size) + 1 rarest shingles that are so in others, too. Two sets of a Jaccard similarity of t or
    more share one of them in any order that holds for all sets. The order is by how many shingles fall into a shingle's cell, so shingles that many documents
    share join nothing, and it is known without moving any shingle: only the rarest ones are shuffled."""
    cells = sets.sparkSession.sparkContext.broadcast(_cells(sets))

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, grams, _ = _rarest(part.column("grams").flatten().to_numpy(), part.column("n").to_numpy().astype(np.int64), cells.value, t)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("class_id").take(row), part.column("n").take(row), pa.array(grams)], names=["class_id", "n", "gram"])

    prefix = keep(sets.select("class_id", "n", "grams").mapInArrow(each, "class_id long, n int, gram long"), "rarest")
    often = prefix.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return keep(prefix.join(often, "gram", "left_semi").select("class_id", "n", "gram"), "prefix")


def _verified(pairs: DataFrame, sets: DataFrame, t: float, texts: DataFrame | None = None, n: int = 5) -> DataFrame:
    """a, b, score of those pairs (a, b) whose sets are that similar. sets: class_id, n and grams; or class_id and n, with texts: class_id and line, of which shingles are made where they are compared.

    A pair goes to a group, named by the smallest id that either of the two is paired with: a family of near copies is one group. Only sets that are in a pair are
    moved, once for each group that has them, and no pair carries a set. A group of more than ``BLOCK`` shingles or ``PAIRS`` pairs is parted into cells of two parts of
    its sets each. If sets have sketches (:func:`sketch`), pairs meet these first."""
    pairs = keep(_grouped(pairs), "candidates")
    of = lambda pairs, *at: pairs.select(*at, F.explode(F.array("a", "b")).alias("class_id")).distinct()
    wanted = keep(of(pairs, "group"), "wanted")
    weights = wanted.join(sets.select("class_id", "n"), "class_id").groupBy("group").agg(F.sum("n").alias("n")).join(pairs.groupBy("group").count(), "group")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.sqrt(2 * F.col("count") / PAIRS))).cast("int").alias("parts")
    large = keep(weights.select("group", parts).where("parts > 1"), "large")
    part = lambda id_: F.pmod(F.xxhash64(id_, F.lit(3)), F.coalesce("parts", F.lit(1))).cast("int")
    pairs = pairs.join(large, "group", "left").select("group", F.least(part("a"), part("b")).alias("x"), F.greatest(part("a"), part("b")).alias("y"), "a", "b")
    if "sketch" in sets.columns:
        wanted = keep(of(pairs, "group", "x", "y"), "wanted")
        pairs = keep(_meet(sets.select("class_id", "n", "sketch").join(wanted, "class_id"), pairs, "sketch", _alike(t)), "alike").drop("both", "either")
    wanted = keep(of(pairs, "group", "x", "y"), "wanted")
    what = "grams" if texts is None else "line"
    held = _held((sets if texts is None else texts).select("class_id", what), wanted).join(wanted, "class_id")
    found = _meet(held.withColumn("n", F.lit(0)), pairs, what, _near_sets(t, n))
    score = F.col("both") / F.col("either")
    return found.where(score >= t).select("a", "b", F.round(score, 6).alias("score"))


def _grouped(pairs: DataFrame) -> DataFrame:
    """group, a, b."""
    pairs = keep(pairs.select("a", "b"), "pairs")
    low = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).groupBy(F.col("p.a").alias("id")).agg(F.least(F.min("p.a"), F.min("p.b")).alias("low"))
    low = keep(low, "lowest")
    of = lambda id_, name: low.select(F.col("id").alias(id_), F.col("low").alias(name))
    return pairs.join(of("a", "u"), "a").join(of("b", "v"), "b").select(F.least("u", "v").alias("group"), "a", "b")


def _held(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets that are wanted, and at a rate of some 1 in 16 others: told by a bit of their ids in a map of 16 bits or more for each of the wanted, up to 64 MB."""
    size, names = 1 << min(29, max(16, (16 * wanted.count()).bit_length())), sets.columns

    def marked(batches):
        own = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & (size - 1)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k, part in enumerate(np.array_split(own, 16)):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], names=["k", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        every = np.zeros(size // 128, np.uint8)
        for c in table.column("bits"):
            every |= np.frombuffer(c.as_py(), np.uint8)
        return pa.table({"k": table.column("k").slice(0, 1), "bits": pa.array([every.tobytes()], pa.binary())})

    ids = wanted.select(F.xxhash64("class_id").alias("id")).coalesce(16)
    rows = sorted(ids.mapInArrow(marked, "k long, bits binary").groupBy("k").applyInArrow(joined, "k long, bits binary").collect())  # 16 rows
    bits = sets.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(r["bits"] for r in rows) or bytes(size // 8), np.uint8))

    def each(batches):
        seen = set()  # copies of one task are sent once
        for batch in batches:
            at = batch.column(0).to_numpy() & (size - 1)
            rows = np.flatnonzero(bits.value[at >> 3] >> (at & 7) & 1)
            ids = batch.column(1).take(pa.array(rows)).to_pylist()
            seen = seen if len(seen) < SEEN else set()
            rows = [r for r, i in zip(rows.tolist(), ids, strict=True) if not (i in seen or seen.add(i))]
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows[k : k + 256])) for c in (1, 2)], names=names)

    return sets.select(F.xxhash64("class_id").alias("at"), *sets.columns).mapInArrow(each, sets.schema)


def _meet(held: DataFrame, pairs: DataFrame, what: str, compared) -> DataFrame:
    """group, x, y, a, b, both, either: what compared gives of the pairs (group, x, y, a, b) and of the sets held (group, x, y, class_id, n, what) where they meet."""
    held = held.select("group", "x", "y", F.lit(0).alias("kind"), F.col("class_id").alias("a"), F.col("n").cast("long").alias("b"), what)
    asked = pairs.select("group", "x", "y", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast(held.schema[what].dataType).alias(what))
    rows = held.union(asked).repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "kind")  # sets, then pairs

    def each(batches):
        at, sets = None, {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
            a, b, out = batch.column(4).to_numpy(), batch.column(5).to_numpy(), []
            for start, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                *group, kind = keys[start].tolist()
                if group != at:
                    at, sets = group, {}
                if kind:
                    order = start + np.argsort(a[start:end], kind="stable")
                    near = [(*group, i, j, *one) for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True) for x in sets[i] for y in sets[j] for one in compared(x, y)]
                    out += [np.array(near, np.int64)] if near else []
                    continue
                for k, (i, size) in enumerate(zip(a[start:end].tolist(), b[start:end].tolist(), strict=True), start):
                    if i not in sets or what == "grams":  # copies have one hash; several sets are those of documents that share an id
                        sets.setdefault(i, []).append(compared(batch.column(6)[k], size, read=True))
            if out:
                columns = np.concatenate(out).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k in (1, 2) else c) for k, c in enumerate(columns)], names=["group", "x", "y", "a", "b", "both", "either"])

    return rows.mapInArrow(each, "group long, x int, y int, a long, b long, both long, either long")


def _near_sets(t: float, n: int):
    """The numbers of shingles in both and in either of two sets, if near; or a set as it is read."""

    def compared(x, y, read=False):
        if read:
            return np.sort(hashes(x.as_py(), n) if pa.types.is_binary(x.type) else x.values.to_numpy())
        both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
        either = len(x) + len(y) - both
        return [(both, either)] if both >= t * either - 1e-9 else []

    return compared


def sketch(grams: np.ndarray) -> bytes:
    """For each of some bits, a power of two and the set's size or more, whether an odd number of shingles fall on it: two sets differ in as many shingles at least as
    their sketches in bits. The halves of a sketch, added up, are the sketch of half the size."""
    bits = max(64, 1 << (len(grams) - 1).bit_length())
    return np.packbits((np.bincount(grams & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _alike(t: float):
    """The bits in which two sketches differ and the most that may differ, if they may be those of near sets; or a sketch with its set's size as it is read."""

    def compared(x, y, read=False):
        if read:
            return np.frombuffer(x.as_py(), np.uint64), y
        (x, n), (y, m) = sorted((x, y), key=lambda one: len(one[0]))
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        differ, most = int(np.bitwise_count(x ^ y).sum()), (n + m) * (1 - t) / (1 + t) + 1e-6
        return [(differ, int(most))] if differ <= most else []

    return compared


def spanning_links(keys: DataFrame, sets: DataFrame, t: float, pivots: int = 1, growth: int = 8) -> DataFrame:
    """a, b: verified links that join the same sets as all links between sets that share a key. keys: class_id, n, gram.

    Of each key the first few sets, one in the first round and growth times as many in each further one, are compared with the others of that key; pairs
    within one cluster, which earlier links have made, and pairs that were compared before are left out. The last round's first sets are all of them. So a
    family of near copies is joined by its first set, and only sets that aren't near are compared with more."""
    most = keys.groupBy("gram").count().agg(F.max("count")).first()[0] or 0
    near = lambda a, b: F.least(a, b) >= F.greatest(a, b) * t - 1e-9
    place = F.row_number().over(Window.partitionBy("gram").orderBy("class_id"))
    placed = keep(keys.withColumn("place", place), "placed")
    links, seen, before = None, None, 0
    while before < most:
        own = placed.withColumn("cluster", F.col("class_id"))
        if links is not None:
            found = duplicate_clusters(links)
            own = placed.join(found, placed["class_id"] == found["node"], "left").select("class_id", "n", "gram", "place", F.coalesce("cluster", "class_id").alias("cluster"))
            own = keep(own, "clustered")
        first = own.where(F.col("place") <= pivots).select("gram", F.col("class_id").alias("a"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("cluster").alias("other"))
        pairs = own.join(first, "gram").where((F.col("place") > F.col("at")) & (F.col("cluster") != F.col("other")) & near(F.col("n"), F.col("m")))
        pairs = pairs.select("a", F.col("class_id").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        found = keep(_verified(pairs, sets, t).select("a", "b"), "links")
        links = found if links is None else links.union(found)
        seen = pairs if seen is None else seen.union(pairs)
        before, pivots = pivots, pivots * growth
    return links if links is not None else sets.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")).limit(0)


def near_duplicates(documents: DataFrame, n: int = 5, t: float = 0.8) -> DataFrame:
    """a, b, score: all pairs of classes whose shingle sets have a Jaccard similarity of t or more. Exact.

    A family of m different near copies has m * (m - 1) / 2 such pairs: :func:`document_clusters` names its members without them."""
    _, sets, pairs = _near(documents, n, t)
    of = lambda key, name: sets.select(F.col("key").alias(key), F.col("class_id").alias(name))
    named = pairs.join(of("a", "u"), "a").join(of("b", "v"), "b").where("u <> v")
    return named.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "score")


def _near(documents: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, digest of every document; key, class_id, class_size, n of every class; a, b, score of near classes, by key. No set of shingles is kept or moved: they are made
    once for the cells' counts, once for the rarest shingles and once more of the classes that are in a pair, where they are compared."""
    scan, cells = _scan(documents, n)
    found = scan.groupBy("digest").agg(F.first("key").alias("key"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    sets = keep(found, "sets")
    own = sets.where("n > 0").select(F.col("key").alias("class_id"), "n", "sketch")
    prefix = _shared_grams(_texts(documents), own.select("class_id", "n"), cells, n, t)
    x, y = (prefix.select("gram", *[F.col(c).alias(c + k) for c in ("class_id", "n", "place", "before")]) for k in "ab")
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * t - 1e-9
    # where this is the first shingle that both have, no more can be shared than the rest of either
    enough = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb")) >= (F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-6
    first = F.coalesce(F.col("beforea") != F.col("beforeb"), F.lit(True))  # else both have the one before it, too
    pairs = x.join(y, "gram").where((F.col("class_ida") < F.col("class_idb")) & sizes & enough & first).select(F.col("class_ida").alias("a"), F.col("class_idb").alias("b")).distinct()
    return scan, sets, _verified(pairs, own, t, _texts(documents), n)


def _scan(documents: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, digest, key (a hash of the tokens), n (shingles) and sketch of each document, kept; and the shingles' counts by cell. Copies that a task has seen before have no n and no sketch."""

    def each(batches):
        own, seen = np.zeros(CELLS, np.int64), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, sizes, sketches, sets = batch.slice(at, 256), [], [], []
                seen = seen if len(seen) < SEEN else set()
                for key, line in zip(part.column("key").to_pylist(), part.column("line").to_pylist(), strict=True):
                    new = line and not (key in seen or seen.add(key))
                    sets += [hashes(line, n)] if new else []
                    sizes.append(len(sets[-1]) if new else None if line else 0)
                    sketches.append(sketch(sets[-1]) if new else None)
                if sets:
                    own += _by_cell(np.concatenate(sets))
                none = [pa.nulls(len(sizes), kind) for kind in (pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "digest", "key")] + [pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), *none], names=names)
        for k, part in enumerate(np.array_split(own, 16)):
            none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([k]), pa.array([part.tobytes()], pa.binary())], names=names)

    names = ["doc_id", "digest", "key", "n", "sketch", "k", "counts"]
    lines = _lines(documents).select("doc_id", F.unhex(F.sha2("line", 256)).alias("digest"), F.xxhash64("line").alias("key"), F.col("line").cast("binary").alias("line"))
    kept = keep(lines.mapInArrow(each, "doc_id long, digest binary, key long, n int, sketch binary, k long, counts binary"), "scan")
    return kept.where("k is null").drop("k", "counts"), _summed(kept.where("k is not null").select("k", "counts"))


def _shared_grams(texts: DataFrame, sizes: DataFrame, cells: np.ndarray, n: int, t: float) -> DataFrame:
    """class_id, n, gram, place, before: of each text's rarest shingles (see :func:`rare_grams`) those that others have there, their place in its order and the one ahead of them."""
    cells = texts.sparkSession.sparkContext.broadcast(cells)

    def each(batches):
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                seen = seen if len(seen) < SEEN else set()
                own = [(i, line) for i, line in zip(part.column("class_id").to_pylist(), part.column("line").to_pylist(), strict=True) if not (i in seen or seen.add(i))]
                if own:
                    sets = [hashes(line, n) for _, line in own]
                    row, grams, place = _rarest(np.concatenate(sets), np.array([len(s) for s in sets]), cells.value, t)
                    ids = np.array([i for i, _ in own], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(grams), pa.array(place.astype(np.int32))], names=["class_id", "gram", "place"])

    rarest = keep(texts.mapInArrow(each, "class_id long, gram long, place int"), "rarest")
    of = Window.partitionBy("gram")
    shared = rarest.select("*", F.min("class_id").over(of).alias("low"), F.max("class_id").over(of).alias("high")).where("low < high").select("class_id", "gram", "place").distinct()
    return keep(shared.join(sizes, "class_id").withColumn("before", F.lag("gram").over(Window.partitionBy("class_id").orderBy("place"))), "prefix")


def _texts(documents: DataFrame) -> DataFrame:
    """class_id (here a hash of the tokens), line of each document with tokens, copies too."""
    return _lines(documents).where("line <> ''").select(F.xxhash64("line").alias("class_id"), F.col("line").cast("binary").alias("line"))


def band_keys(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """class_id, n, gram: MinHash bands as keys; a band is the hash of its number and of the least of ``rows`` hashes of a set each."""
    rng = np.random.default_rng(17)
    times, plus = (rng.integers(0, 1 << 63, bands * rows, np.uint64) for _ in range(2))
    times |= np.uint64(1)

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("grams")
                flat, starts = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
                least = np.stack([np.minimum.reduceat((flat * a + b) >> np.uint64(1), starts) for a, b in zip(times, plus, strict=True)], axis=1)
                keys = np.zeros((len(part), bands), np.uint64)
                for r in range(rows):  # mixed so that equal minima in other places give other keys
                    keys = (keys ^ least[:, r::rows]) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(29)
                keys += np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
                yield pa.RecordBatch.from_arrays([part.column("class_id").take(pa.array(np.repeat(np.arange(len(part)), bands))), pa.array(np.repeat(part.column("n").to_numpy(), bands)), pa.array(keys.ravel().view(np.int64))], names=["class_id", "n", "gram"])

    return sets.select("class_id", "n", "grams").mapInArrow(each, "class_id long, n int, gram long")


def near_duplicates_lsh(documents: DataFrame, t: float = 0.8, n: int = 5, bands: int = 20, rows: int = 5) -> DataFrame:
    """a, b, score: near pairs of classes found by MinHash, each verified on its whole sets. A pair of similarity s shares no band with a probability of
    (1 - s**rows)**bands: 1 in 2,800 at 0.8 and one in four has a common band at 0.42, so few others are compared."""
    sets = hashed_sets(documents, n)
    keys = keep(band_keys(sets, bands, rows), "bands")
    other = keys.select(F.col("class_id").alias("b"), F.col("n").alias("m"), "gram")
    pairs = keys.join(other, "gram").where((F.col("class_id") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * t - 1e-9))
    return _verified(pairs.select(F.col("class_id").alias("a"), "b").distinct(), sets, t)


def duplicate_clusters(pairs: DataFrame) -> DataFrame:
    """node, cluster: the smallest id that each node of a pair reaches. Labels sink along pairs and jump to their labels' labels."""
    both = keep(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "both")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("cluster")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("cluster").alias("low"))
        sunk = labels.join(near, labels["node"] == near["a"]).select("node", F.col("cluster").alias("old"), F.least("cluster", "low").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("cluster").alias("jump"))
        step = keep(sunk.join(up, "low", "left").select("node", "old", F.least("low", F.coalesce("jump", "low")).alias("cluster")), "labels")
        labels = step.select("node", "cluster")
        if step.where("old <> cluster").isEmpty():
            return labels


def contains_passage(documents: DataFrame, benchmark: DataFrame, n: int = 5) -> DataFrame:
    """item_id, doc_id: passages that documents hold verbatim.

    A passage's second to last but one word stand between spaces in any text that holds it, so the first n of
    them (all, if they are fewer) are its key. Passages of one or two words are keys themselves. One pass over the texts makes the runs of
    words and parts of texts of all the keys' lengths; then the texts of the (passage, document) pairs found are searched.
    Null and empty passages are in no document; rows that repeat an id count as one document.
    """
    items = with_array(benchmark.where("text <> ''").select("item_id", F.col("text").alias("passage")), "w", F.split("passage", " "))
    items = items.withColumn("k", F.greatest(F.least(F.size("w") - 2, F.lit(n)), F.lit(0)))
    items = items.withColumn("chars", F.when(F.col("k") == 0, F.length("passage")).otherwise(0))
    key = F.when(F.col("k") == 0, F.col("passage")).otherwise(F.array_join(F.slice("w", F.lit(2), F.greatest("k", F.lit(1))), " "))
    items = items.select("item_id", "passage", "k", "chars", F.xxhash64("k", "chars", key).alias("gram"))
    lengths = sorted((r["k"], r["chars"]) for r in items.select("k", "chars").distinct().collect())  # n, and the lengths of short passages, at most
    docs = documents.select("doc_id", "text")
    keys = [_runs(k, chars) for k, chars in lengths] or [F.array().cast("array<bigint>")]
    grams = with_array(docs.where("text is not null"), "w", F.split("text", " ")).select("doc_id", F.explode(F.array_distinct(F.concat(*keys))).alias("gram"))
    found = grams.join(items.select("item_id", "passage", "gram"), "gram").select("item_id", "doc_id", "passage").distinct()
    return found.join(docs, "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id").distinct()


def _runs(k: int, chars: int):
    """Hashes of a text's runs of k words, or of its parts of so many characters if k is 0."""
    if k:
        runs = shingles("w", k)
    else:
        at = F.sequence(F.lit(1), F.greatest(F.length("text") - (chars - 1), F.lit(1)))
        runs = F.transform(at, lambda i: F.substring(F.col("text"), i, F.lit(chars)))
    return F.transform(runs, lambda g: F.xxhash64(F.lit(k), F.lit(chars), g))
