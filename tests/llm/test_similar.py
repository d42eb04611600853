import random

import pytest

import corpus_pipeline
from loreforge.llm import similar
from loreforge.llm.common import table

from .test_simhash import closure


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near(texts):
    """All pairs of ids at 0.8 or more, by brute force."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def kept(texts):
    left = closure(texts, near(texts))
    return sorted(i for i in texts if left[i] == i)


def test_pipeline_stage_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.without_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == kept(texts)


@pytest.mark.parametrize("pivots", [2, 64])
def test_groups_and_chains(spark, monkeypatch, pivots):
    """Groups around a text that is not the smallest, chains, sets just above and below 0.8, copies and short texts."""
    monkeypatch.setattr(similar, "PIVOTS", pivots)
    monkeypatch.setattr(similar, "GROWTH", 2)
    rng, rows = random.Random(4), []
    word = lambda: f"w{rng.randrange(100_000)}"
    for _ in range(3):
        base = [word() for _ in range(120)]
        for _ in range(20):
            w = list(base)
            for at in rng.sample(range(0, 120, 10), rng.randrange(1, 4)):
                w[at] = word()
            rows.append(w)
        rows.append(base)
    chain = [word() for _ in range(100)]
    for _ in range(12):
        rows.append(list(chain))
        chain = chain[7:] + [word() for _ in range(7)]
    for cut in range(16, 27):
        own = [word() for _ in range(104)]
        rows += [own, own[: 104 - cut]]
    rows += [["A", "b"], ["a", "B"], [], [], ["one"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"]]
    rng.shuffle(rows)
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.drop_copies(docs).collect()) == kept(texts)
    repeated = spark.createDataFrame([(1, "a b c d e f"), (1, "A b c d e f"), (None, "x"), (None, None)], "doc_id long, text string")
    assert similar.drop_copies(repeated).count() == 3
    assert similar.drop_copies(docs.limit(0)).count() == 0


def test_a_family_with_a_template_makes_few_pairs(spark, monkeypatch):
    """Texts at about 0.66 for their template, none near another but two: verified pairs grow with the texts, not with their square."""
    rng, n = random.Random(9), 300
    word = lambda: f"w{rng.randrange(1_000_000)}"
    template = [word() for _ in range(160)]
    texts = {i: " ".join(template + [word() for _ in range(40)]) for i in range(n)}
    texts[n] = texts[7] + " end"
    counts, near_ = [], similar._near
    monkeypatch.setattr(similar, "_near", lambda pairs, sets, t: counts.append(pairs.count()) or near_(pairs, sets, t))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = similar.drop_copies(docs)
    assert sorted(r["doc_id"] for r in out.collect()) == kept(texts) == list(range(n))
    print(counts)
    assert sum(counts) < 16 * n  # of 45150


def test_fingerprints_link_first(spark, monkeypatch):
    """Pairs from fingerprints join the texts that brute force over all fingerprints joins, and MinHash is asked only about what they leave apart."""
    rng, rows = random.Random(6), []
    word = lambda: f"w{rng.randrange(100_000)}"
    for _ in range(8):
        base = [word() for _ in range(400)]
        rows += [base + [word()] * (k % 3) + [word() for _ in range(k // 3)] for k in range(9)]
    rows += [[word() for _ in range(30)] for _ in range(40)]
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {r["id"]: r["fp"] & 2**64 - 1 for r in similar.sketches(docs, "doc_id", "text", 5).collect()}
    for i, fp in prints.items():
        h = [int(x) for x in similar.shingles(texts[i].encode())]
        assert fp == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    left = closure(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    found = similar.by_prints(similar.sketches(docs, "doc_id", "text", 5).select("id", "n", "fp"), 0.8).collect()
    assert closure(prints, found) == left and sum(left[i] != i for i in left) >= 50
    asked, near_ = [], similar._near
    monkeypatch.setattr(similar, "_near", lambda pairs, sets, t: asked.append([tuple(r) for r in pairs.collect()]) or near_(pairs, sets, t))
    assert sorted(r["doc_id"] for r in similar.drop_copies(docs).collect()) == kept(texts)
    assert set(asked[0]) == {tuple(r) for r in found} and all(left[a] != left[b] for more in asked[1:] for a, b in more)
