import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from loreforge.llm import packing
from loreforge.llm.subwords import crc, public

NAME = "byte_bpe_50k.json"


def one_by_one(lengths, capacity):
    """Best-two-fit over single pieces."""
    left, bins = sorted(lengths), []
    while left:
        used, room = [], capacity
        while fits := [x for x in left if x <= room]:
            used.append(fits[-1])
            left.remove(fits[-1])
            room -= fits[-1]
        if len(used) > 1 and room:
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[:i] if a + b <= room + used[-1]]
            if pairs and max(pairs)[0] > used[-1]:
                _, a, b = max(pairs)
                left = sorted([*left, used.pop()])
                left.remove(a)
                left.remove(b)
                used += [a, b]
        bins.append(tuple(sorted(used)))
    return Counter(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_the_one_by_one_algorithm(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([20, 60, 100])) for _ in range(rng.randint(1, 150))]
    got = Counter()
    for used, n in packing.plan(Counter(lengths), 100):
        got[tuple(sorted(used))] += n
    assert got == one_by_one(lengths, 100)


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(0)
    counts = {length: rng.randint(1, 10**9) for length in range(1, 513)}
    bins = packing.plan(counts, 512)
    assert len(bins) < 5 * 512
    total = sum(length * n for length, n in counts.items())
    assert sum(n for _, n in bins) <= 1.02 * total / 512 + 1  # 1.013


def check(rows, out, capacity):
    coder = Tokenizer.from_file(public(NAME))
    by_doc, places = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0])
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        assert all(r["length"] == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    return places


def test_pieces_and_places(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["one", "two,", "Three"]) for _ in range(rng.randrange(200)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "word " * 5000), (303, "hello <|endoftext|> world"), (None, "no id")] + [(i, "same text") for i in range(400, 700)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int").repartition(3)
    packed = packing.pack(docs, public(NAME), capacity=128)
    places = check(rows, packed.collect(), 128)
    total = sum(n for parts in places.values() for _, n in parts)
    assert len(places) <= 1.02 * total / 128 + 1
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == 2 * sum(p["length"] for p in r["parts"])


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, public(NAME), with_ids=False).count() == 0
    twice = spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string")
    assert packing.pack(twice, public(NAME), with_ids=False).select("sequence_id", "offset").distinct().count() == 3
