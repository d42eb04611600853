import random
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loreforge.llm import common, simhash
from loreforge.llm.components import components


def by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def closure(ids, near):
    """The smallest id that each reaches."""
    left = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            m = min(left[a], left[b])
            if left[a] != m or left[b] != m:
                left[a] = left[b] = m
                changed = True
    return left


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d", "a b c d e f g\th i j ÉÀ K" * 9, "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == by_hand(text)


@pytest.mark.parametrize("depth", [0, 1, 5, 11])
def test_tree_covers_every_ball(depth):
    home, starts, leaves = simhash.tree(depth)
    assert len(set(home.tolist())) == max(home) + 1 <= 2**depth
    for value in np.random.default_rng(depth).integers(0, 65536, 2000).tolist():
        seen = {home[value], *leaves[starts[value] : starts[value + 1]].tolist()}
        for bit in range(16):
            other = home[value ^ 1 << bit]
            assert other in seen or other < home[value]


@pytest.mark.parametrize("split", [1, 1 << 23])
def test_groups_against_brute_force(spark, monkeypatch, split):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = [s for s in seeds for _ in range(3)]
    for s in seeds:
        for _ in range(8):
            x = s
            for b in rng.sample(range(64), rng.randrange(1, 8)):
                x ^= 1 << b
            prints.append(x)
    prints += [0, 0, 2**64 - 1]
    monkeypatch.setattr(simhash, "SPLIT", split)
    found = []
    fps = np.unique(np.array(prints, np.uint64))
    for q in range(4):
        simhash.links(fps, fps[:0], q, 4, lambda a, b: found.extend(zip(a.tolist(), b.tolist(), strict=True)))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert set(found) == want
    monkeypatch.setattr(simhash, "LEAF", 16)
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    out = simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long"))
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == closure(range(len(prints)), near)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 - i, 1001 - i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)]
    ids = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in closure({x for e in edges for x in e}, edges).items() if i in ids}


def test_rows(spark):
    schema = "doc_id long, text string, fp string"
    assert simhash.groups(simhash.fingerprints(spark.createDataFrame([], schema))).count() == 0
    rows = [(3, "a b c d e", "x"), (2, "A  b c\nd e", "x"), (9, None, "x"), (8, " ", None), (None, "alone", "x"), (5, "long text " * 30_000, "x"), (5, "other", "x")]
    docs = spark.createDataFrame(rows, schema)
    out = simhash.groups(simhash.fingerprints(docs))
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in out.collect() if r["doc_id"] != 5) == [("2", 2), ("3", 2), ("8", 8), ("9", 8), ("None", None)]
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    unique = docs.where(F.col("doc_id").isin(3, 2, 9, 8))
    assert sorted(r["doc_id"] for r in simhash.drop_near(unique).collect()) == [2, 8]


def test_few_steps_and_few_files(spark, monkeypatch):
    """Stars need no step; a step's narrow tables are in no more files than their rows need, however many partitions a shuffle has."""
    kept, freeze = [], common.freeze
    monkeypatch.setattr(sys.modules["loreforge.llm.components"], "freeze", lambda *a, **b: kept.append(freeze(*a, **b)) or kept[-1])
    stars = [(1, i) for i in range(2, 300)] + [(300, i) for i in range(301, 330)]
    got = components(spark.createDataFrame(stars, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {i: 1 if i < 300 else 300 for i in range(1, 330)} and len(kept) == 1
    for name, value in (many := {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}).items():
        many[name] = spark.conf.get(name)
        spark.conf.set(name, value)
    try:
        kept.clear()
        got = components(spark.createDataFrame([*stars, (299, 300)], "a long, b long"), len(stars) + 1)
        assert {r["component"] for r in got.collect()} == {1} and got.count() == 329
        assert 1 < len(kept) and all(len(k.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism for k in kept)
    finally:
        for name, value in many.items():
            spark.conf.set(name, value)
