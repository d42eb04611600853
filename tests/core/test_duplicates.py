"""Near duplicates by brute force, and what large families cost."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loreforge.operators import duplicates

SCHEMA = "doc_id long, text string"


def grams(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)}


def brute(docs, t=0.8):
    """All near pairs, and the smallest id that each document of a pair reaches."""
    sets = [(i, grams(x)) for i, x in docs]
    pairs = {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= t * len(x | y)}
    label = {i: i for i, _ in docs}
    for _ in docs:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return pairs, {i: c for i, c in label.items() if any(i in p for p in pairs)}


def family(rng, first, m, length, own):
    """m texts of one base, each with some words of its own at its end."""
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    return [(first + i, " ".join(base + [f"x{rng.randrange(10**9)}" for _ in range(rng.randrange(1, own))])) for i in range(m)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    chain = [f"c{i}" for i in range(120)]
    out = family(rng, 0, 40, 60, 8) + family(rng, 100, 30, 60, 40) + family(rng, 200, 20, 8, 4)
    out += [(300 + i, " ".join(chain[3 * i : 3 * i + 60])) for i in range(20)]  # each near its neighbours alone
    return out + [(400 + i, " ".join(f"y{rng.randrange(9999)}" for _ in range(30))) for i in range(30)]


def test_pairs_and_clusters_by_brute_force(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    pairs, label = brute(docs)
    assert {(r["a"], r["b"]) for r in duplicates.near_duplicates(df).collect()} == pairs
    assert {r["node"]: r["cluster"] for r in duplicates.document_clusters(df).collect()} == label
    lsh = {(r["a"], r["b"]) for r in duplicates.near_duplicates_lsh(df).collect()}
    assert lsh <= pairs and len(lsh) >= 0.99 * len(pairs)


def test_a_family_costs_a_pair_a_text(spark, monkeypatch):
    rng, seen = random.Random(5), []
    df = spark.createDataFrame(family(rng, 0, 300, 80, 6), SCHEMA)
    verified = duplicates._verified

    def counted(pairs, sets, t):
        seen.append(pairs.count())
        return verified(pairs, sets, t)

    monkeypatch.setattr(duplicates, "_verified", counted)
    assert {r["cluster"] for r in duplicates.document_clusters(df).collect()} == {0}
    assert sum(seen) < 2 * 300  # all pairs: 44,850


def test_templates_are_not_compared(spark, monkeypatch):
    """Texts that share two thirds of their shingles and are not near."""
    rng, seen = random.Random(6), []
    base = " ".join(f"w{i}" for i in range(64))
    df = spark.createDataFrame([(i, base + " " + " ".join(f"x{rng.randrange(10**9)}" for _ in range(20))) for i in range(200)], SCHEMA)
    verified = duplicates._verified
    monkeypatch.setattr(duplicates, "_verified", lambda pairs, sets, t: (seen.append(pairs.count()), verified(pairs, sets, t))[1])
    assert duplicates.document_clusters(df).count() == 0 and sum(seen) < 200
    assert duplicates.near_duplicates_lsh(df).count() == 0


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert duplicates.document_clusters(df).count() == duplicates.near_duplicates_lsh(df).count() == 0


def test_sets_are_hashed_in_tasks(spark):
    """The same sets as Spark's own hashes of the shingles, with no list of shingles as strings in the plan."""
    odd = [(1, "A b, c d e f"), (2, "a B c D e"), (3, "one two"), (4, None), (5, " .,"), (6, "É é x1 ß ſ İ Σας x x x x x x x x"), (7, "one,two"), (None, "b c d e f g")]
    df = spark.createDataFrame(odd, SCHEMA)
    want = {r["class_id"]: sorted(r["h"]) for r in duplicates.shingle_sets(df).selectExpr("class_id", "array_distinct(transform(grams, g -> xxhash64(g))) AS h").collect()}
    sets = duplicates.hashed_sets(df)
    assert {r["class_id"]: sorted(r["grams"]) for r in sets.collect()} == want and len(want) == 5
    assert all(r["n"] == len(r["grams"]) for r in sets.collect())
    assert duplicates.hashed_sets(df.limit(0)).count() == 0
    used = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(duplicates, "shingles", lambda *a: used.append(a))
        assert duplicates.hashed_sets(df).count() == 5 and not used


def test_links_are_counted_without_moving_sets_with_pairs(spark, docs, monkeypatch):
    kept, keep, df = [], duplicates.keep, spark.createDataFrame(docs + [(500 + i, x) for i, x in docs[:3]], SCHEMA)
    monkeypatch.setattr(duplicates, "keep", lambda df, *what: kept.append(keep(df, *what)) or kept[-1])
    pairs, _ = brute(docs)
    links = {i: sum(i in p for p in pairs) for i, _ in docs}
    want = {(i, i, 1 + (i < 3), links[i]) for i in links} | {(500 + i, i, 2, links[i]) for i in range(3)}
    for block in (1 << 22, 500):  # one group, and cells of large groups
        monkeypatch.setattr(duplicates, "BLOCK", block, raising=False)
        assert {tuple(r) for r in duplicates.near_duplicate_classes(df).collect()} == want
    assert kept and not any("array" in kind for k in kept for _, kind in k.dtypes)  # sets are made where they are compared
    plan = duplicates.near_duplicates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan


def test_shuffled_files_go_with_the_write(spark, docs):
    from pathlib import Path

    from loreforge.sources.tables import keep

    folders = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders() for f in Path(d).rglob("shuffle_*_0.data")}
    before = files()
    kept = keep(spark.createDataFrame(docs, SCHEMA).repartition(3, "text"))
    assert files() <= before
    assert kept.count() == len(docs)


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    rng = np.random.default_rng(4)
    compared = duplicates._alike(0.8)
    for n in (1, 3, 64, 65, 700, 4000):
        whole = np.unique(rng.integers(-(1 << 62), 1 << 62, 2 * n))
        base = whole[:n]
        for m in sorted({1, n // 2 or 1, n - n // 10, n}):
            for other in (base[:m], np.sort(np.concatenate([base[n - m // 2 :], whole[n:][: m - m // 2]]))):
                x, y = (compared(pa.scalar(duplicates.sketch(g), pa.binary()), len(g), read=True) for g in (base, other))
                both = len(np.intersect1d(base, other))
                found = compared(x, y)
                assert found == compared(y, x) and all(d <= n + len(other) - 2 * both for d, _ in found)
                assert found or both < 0.8 * (n + len(other) - both)
                assert not found or n < 64 or m < 0.8 * n or both > 0.4 * (n + len(other) - both)  # and others are told apart


def test_texts_of_unlike_sketches_are_not_moved(spark, docs, monkeypatch):
    kept, keep, df = {}, duplicates.keep, spark.createDataFrame(docs, SCHEMA)
    monkeypatch.setattr(duplicates, "keep", lambda df, what="kept": kept.setdefault(what, []).append(keep(df, what)) or kept[what][-1])
    pairs, _ = brute(docs)
    for most in (1 << 16, 50):  # a group's pairs in one cell, and in several
        monkeypatch.setattr(duplicates, "PAIRS", most, raising=False)
        kept.clear()
        assert {(r["a"], r["b"]) for r in duplicates.near_duplicates(df).collect()} == pairs
        assert len(pairs) <= kept["alike"][0].count() <= kept["candidates"][0].count()
        assert kept["large"][0].isEmpty() == (most > 50)
