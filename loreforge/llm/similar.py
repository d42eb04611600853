"""Near copies by fingerprints and shingles: groups of texts linked by a Jaccard similarity of 0.8 or more, for the pipeline.

A text's shingles are its runs of five words, lower-cased (A-Z); a shorter text is one shingle. Its fingerprint is the SimHash of this set.
Texts whose fingerprints differ in ``BITS`` bits at most are looked up first, by :mod:`simhash`'s trees, and those whose whole sets are similar
are linked. At 0.8 fingerprints differ in about ten bits, and no split of 64 bits that reaches so far rules much out. So what they leave
apart is looked up by MinHash: ``BANDS`` keys of ``ROWS`` minima each, which a pair at 0.8 shares none of with a
probability of (1 - 0.8**5)**32, about 3 in a million, and less above. Pairs found whose minima's single bits differ in more than ``far(t)`` of
128 places, which a pair at 0.8 does with a probability of about 6 in a million, are not near; all others, but those within a group that fingerprints
have made, are verified on their whole sets.

Texts with equal sets are folded first. Of the texts with one key, pairs with the smallest id come first. Texts that then have
a key in common with texts of other groups are looked up by their rarest shingles: two sets of a similarity of t share one of the first n - ceil(t n) + 1
in any order that holds for all (Chaudhuri et al. 2006), and by rising number of texts those are a text's own words, not what a family of
texts shares. Pairs that share one and are still in different groups come in rounds, from some of the texts to all others and more in
each round, until all are verified or linked by others. So a large group of near copies costs few pairs a text, a
family of texts that have a template in common next to none, and no pair is left out.

Null and blank texts are one shingle, and so copies of each other.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, fresh, in_arrow, slices, small
from .components import components
from .simhash import near_prints, of_hashes

#: Bits in which fingerprints that are looked up differ at most.
BITS = 4
BANDS, ROWS = 32, 5
#: Texts of the largest key from which pairs start in the second round, about; each later round has GROWTH times as many.
PIVOTS, GROWTH = 64, 8
_RNG = np.random.default_rng(17)
_TIMES, _PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order. bytes.lower() and bytes.split() know A-Z and the blanks 09-0D and 20 alone."""
    import xxhash

    words = (text or b"").lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    if len(words) <= width:
        return np.array([digest(line, 42)], np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    bounds = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.array([digest(line[a:b], 42) for a, b in bounds], np.uint64))


def far(t: float) -> int:
    """Of 128 bits, how many may differ where the similarity is t: five standard deviations above the mean."""
    p = (1 - t) / 2
    return int(128 * p + 5 * (128 * p * (1 - p)) ** 0.5)


def keys(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and two words of one bit of each of the first 128 minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 1024):
        low = np.minimum(low, (grams[k : k + 1024, None] * _TIMES + _PLUS).min(0))
    low ^= low >> np.uint64(29)
    bits = np.packbits((low[:128] >> np.uint64(20)).astype(np.uint8) & 1).view(np.int64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64), bits


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n (shingles), fp (the set's fingerprint), h1 and h2 (hashes of the set), b1 and b2 (bits of its minima), keys."""

    def each(batches):
        import xxhash

        for part in slices(batches, 256):
            if part.num_rows:
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                made = [keys(s) for s in sets]
                bits = np.array([b for _, b in made])
                whole = np.array([[xxhash.xxh64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64).view(np.int64)
                fps = np.array([of_hashes(s) for s in sets], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([k for k, _ in made])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), lists], names=["id", "n", "fp", "h1", "h2", "b1", "b2", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary"))
    return in_arrow(rows, each, "id long, n int, fp long, h1 long, h2 long, b1 long, b2 long, keys array<long>")


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, grams."""

    def each(batches):
        for part in slices(batches, 256):
            sets = [shingles(t, width).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "grams"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary"))
    return in_arrow(rows, each, "id long, grams array<long>")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, t: float = 0.8) -> DataFrame:
    """id: the texts that are not the smallest id of their group. Ids must be unique."""
    all_ = freeze(sketches(docs, id_col, text_col, width), "sketches")
    n_texts = all_.count()
    least = freeze(all_.groupBy("h1", "h2").agg(F.min("id").alias("first")), "sets", rows=n_texts).select(F.col("first").alias("id"))
    same = all_.select("id").join(least, "id", "left_anti")
    alike = freeze(by_prints(all_.join(least, "id", "left_semi").select("id", "n", "fp"), t, n_texts), "alike", rows=n_texts)
    each = all_.join(least, "id", "left_semi").select(F.explode("keys").alias("key"), "id", "n", "b1", "b2")
    shared = each.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = freeze(each.join(shared, "key").withColumn("place", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40)) / (1 << 40)), "members", rows=n_texts * BANDS)
    if members.isEmpty() and alike.isEmpty():
        return same
    wanted = members.select("id").union(alike.select("a")).union(alike.select("b"))
    wanted = freeze(wanted.select(F.col("id").alias("wanted")).distinct(), "wanted", rows=n_texts)
    texts = docs.select(id_col, text_col)
    sets = freeze(sets_of(texts.join(small(wanted), texts[id_col] == F.col("wanted"), "left_semi"), id_col, text_col, width), "grams")
    first = members.where(F.col("id") == F.col("least")).select(F.col("key").alias("same"), F.col("id").alias("a"), F.col("n").alias("an"), F.col("b1").alias("a1"), F.col("b2").alias("a2"))
    pairs = first.join(members, (F.col("key") == F.col("same")) & (F.col("id") > F.col("a")) & _alike(t)).select("a", F.col("id").alias("b")).distinct()
    labels = _more(None, _near(alike, sets, t))
    labels = _more(labels, _near(freeze(_apart(pairs, labels), "pairs", rows=n_texts), sets, t))
    open_ = _open(members, labels).select("id").distinct()
    rare = freeze(prefixes(sets.join(open_, "id", "left_semi"), t), "prefixes")
    rare = freeze(rare.join(all_.select("id", "b1", "b2"), "id").withColumn("place", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40)) / (1 << 40)), "rare")
    share = done = 0.0
    while done < 1:
        now = freeze(_open(rare, labels), "open")
        largest = now.groupBy("key").count().agg(F.max("count")).first()[0]
        if largest is None:
            break
        share = min(1.0, max(share * GROWTH, PIVOTS / largest))
        some = now.where(F.col("place") < share).select(F.col("key").alias("same"), F.col("id").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"), F.col("place").alias("ap"), F.col("pos").alias("at"), F.col("b1").alias("a1"), F.col("b2").alias("a2"))
        fresh = (F.col("label") != F.col("al")) & (F.least("place", "ap") >= done)
        # where this is the first shingle that both have, no more can be shared than the rest of either
        enough = 1 + F.least(F.col("n") - F.col("pos"), F.col("an") - F.col("at")) >= (F.col("n") + F.col("an")) * (t / (1 + t)) - 1e-6
        pairs = some.join(now, (F.col("key") == F.col("same")) & fresh & enough & _alike(t)).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        labels = _more(labels, _near(freeze(pairs, "pairs", rows=n_texts), sets, t))
        done = share
    return same if labels is None else same.union(labels.where("node <> component").select(F.col("node").alias("id")))


def by_prints(prints: DataFrame, t: float, n_texts: int | None = None) -> DataFrame:
    """a, b: of texts (id, n, fp) whose fingerprints are linked, by one or by several steps of ``BITS`` bits, pairs that join them all, if the sizes allow a similarity of t.
    Texts with one fingerprint are paired with the smallest id of them."""
    prints = freeze(prints, "prints", rows=n_texts)
    first = freeze(prints.groupBy("fp").agg(F.min_by(F.struct("id", "n"), "id").alias("first")), "first", rows=n_texts)
    of = lambda fp, id_, n: first.select(F.col("fp").alias(fp), F.col("first.id").alias(id_), F.col("first.n").alias(n))
    copies_ = prints.join(of("fp", "a", "an"), "fp").where("id <> a").select("a", "an", F.col("id").alias("b"), F.col("n").alias("bn"))
    edges = freeze(near_prints(first.select("fp"), BITS).select(F.col("a").alias("f"), F.col("b").alias("g")).distinct(), "near_prints", rows=n_texts)
    others = edges.join(of("f", "a", "an"), "f").join(of("g", "b", "bn"), "g").select("a", "an", "b", "bn")
    pairs = copies_.union(others).where(F.least("an", "bn") >= F.greatest("an", "bn") * t - 1e-9)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs a, b whose texts are in different groups."""
    if labels is None:
        return pairs
    of = lambda id_, label: labels.select(F.col("node").alias(id_), F.col("component").alias(label))
    both = pairs.join(of("a", "al"), "a", "left").join(of("b", "bl"), "b", "left")
    return both.where(F.col("al").isNull() | F.col("bl").isNull() | (F.col("al") != F.col("bl"))).select("a", "b")


def _alike(t: float):
    """Of n, b1, b2 against an, a1, a2: whether the sizes and the minima's bits allow a similarity of t."""
    bits = F.bit_count(F.col("b1").bitwiseXOR(F.col("a1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("a2")))
    return (F.least("n", "an") >= F.greatest("n", "an") * t - 1e-9) & (bits <= far(t))


def _near(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs a, b whose whole sets are similar."""
    found = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    found = found.select("a", "b", (F.size("x") + F.size("y")).alias("all"), F.size(F.array_intersect("x", "y")).alias("both"))
    return freeze(found.where(F.col("both") >= (F.col("all") - F.col("both")) * t - 1e-9).select("a", "b"), "edges", rows=pairs.count())


def _more(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """node, component after the links found; labels as edges, so that groups that stay as they are need no further step."""
    if found.isEmpty():
        return labels
    links = found if labels is None else found.union(labels.select("node", "component"))
    n = links.count()
    return freeze(components(links, n), "labels", rows=2 * n)


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members (key, id) with the label of their group, of those keys whose texts are in several groups."""
    now = members.withColumn("label", F.col("id"))
    if labels is not None:
        of = labels.select(F.col("node").alias("id"), "component")
        now = members.join(of, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    open_ = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return now.join(open_, "key", "left_semi")


def prefixes(sets: DataFrame, t: float) -> DataFrame:
    """id, n, key and pos: of each text's n shingles, in the order of how many of these texts have them, those among the first
    n - ceil(t n) + 1 that others have too. Texts of a similarity of t or more share one of them."""
    each = sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("key"))
    often = freeze(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    shared = each.join(often, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("ranked"))
    alone = F.col("n") - F.size("ranked")  # these come first
    first = F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1 - alone
    rows = shared.where(first > 0).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("ranked", F.lit(1), first.cast("int"))).alias("pos", "one"))
    return rows.select("id", "n", F.col("one.key").alias("key"), (F.col("alone") + F.col("pos") + 1).alias("pos"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, t: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest id, or the first where ids repeat or are null."""
    own, unclear = id_col, not docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty()
    if unclear:
        own = fresh(docs, "__row")[0]
        docs = freeze(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    name = fresh(docs, "__gone")[0]
    gone = freeze(copies(docs, own, text_col, width, t).select(F.col("id").alias(name)), "gone")
    return docs.join(small(gone), docs[own] == F.col(name), "left_anti").select(*[c for c in docs.columns if c != own or not unclear])
