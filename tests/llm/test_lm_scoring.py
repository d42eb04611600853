import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loreforge.llm import lm_scoring as lm
from loreforge.llm.common import table
from loreforge.llm.subwords import Encoder, public

NAME, END = "byte_bpe_50k.tiktoken", 50256


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("frequent", [50, 1 << 18])
def test_base_and_counts(spark, monkeypatch, frequent):
    """Counts and base scores by brute force, with few and with all words in the table that tasks get."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "ROUNDS", 1)
    monkeypatch.setattr(lm, "STEPS", 2)
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \t"), (9004, "THE the x É"), (9004, "the"), (None, "the"), (9005, "<|endoftext|> a b"), (9006, "very long text " * 30_000)], docs.schema)
    docs = docs.union(odd)
    rows = docs.collect()
    out = lm.score(docs.select("*", docs.text.alias("word"), docs.doc_id.alias("tag")), public(NAME), END).collect()
    c = Counter()
    for r in rows:
        if not held(r["doc_id"]):
            c.update([*words(r["text"]), None])
    n, v = sum(c.values()), len(c)
    want = sorted((r["doc_id"] or -1, held(r["doc_id"]), len(w := [*words(r["text"]), None]), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for r in rows)
    got = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert len(got) == len(want) and all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(b[5]) + 1e-4 for a, b in zip(got, want, strict=True))
    assert all(r["score"] < 0 for r in out)


def test_empty_and_untrained(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert lm.score(docs.limit(0), public(NAME), END).count() == 0
    alone = spark.createDataFrame([(next(i for i in range(100) if held(i)), "no training text")], docs.schema)
    r = lm.score(alone, public(NAME), END).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_texts_score_above_word_counts(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    out = lm.score(docs, public(NAME), END).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert out[0] > out[1]


def small(seed=0, kinds=lm._PAD):
    rng = np.random.default_rng(seed)
    net = lm.Network.made(rng.integers(0, 5, kinds))
    net.w["h"][:-1] = rng.standard_normal(net.w["h"][:-1].shape) * 0.1
    net.w["k"][:, :-1] = rng.standard_normal(net.w["k"][:, :-1].shape) * 0.1
    return rng, net


def test_gradients():
    rng, net = small()
    net.w = {k: w.astype(float) for k, w in net.w.items()}
    x, y = rng.integers(0, lm._PAD + 1, (3, lm.PLACES)), rng.integers(0, lm._PAD, (3, lm.STRIDE))
    y[1, 4:], y[2] = lm._PAD, lm._PAD
    g, loss = net.gradients(x, y)
    value = lambda: -net.log_probs(x, y).mean()
    assert abs(loss - value()) < 1e-6
    for name, w in net.w.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old, e = w[at], 1e-5
        w[at] = old + e
        up = value()
        w[at] = old - e
        down, w[at] = value(), old
        assert abs((up - down) / (2 * e) - g[name][at]) < 1e-5, name


def by_hand(net, x, y):
    """log P(y | the classes x ahead of it), place by place in plain loops. x: from the window's first place on."""
    w = net.w
    e = [w["e"][c] + w["p"][i] for i, c in enumerate(x)]
    a = np.exp(np.array([(e[-1] @ w["a"]) @ k for k in e]))
    h = e[-1] + (sum(u * v for u, v in zip(a / a.sum(), e, strict=True))) @ w["o"]
    z = h + np.maximum(h @ w["w1"], 0) @ w["w2"]
    top, group = np.exp(z @ w["h"]), y // lm.MEMBERS
    below = np.exp(z @ w["k"][group])
    return np.log(top[group] / top.sum() * below[y % lm.MEMBERS] / below.sum())


def test_each_id_is_scored_once_and_in_context(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 3)
    rng, net = small(1)
    kinds, share = rng.permutation(lm._PAD)[:30].astype(np.int32), np.log(np.full(30, 0.1))
    scorer = lm.Scorer(net.w, kinds, share, 29)
    texts = [np.append(rng.integers(0, 29, n), 29) for n in (0, 4, 31, 32, 33, 200, 96)]
    want = []
    for ids in texts:
        total = 0.0
        for i in range(len(ids)):
            first = i // lm.STRIDE * lm.STRIDE - lm.CONTEXT
            x = [lm._PAD if j < 0 else kinds[29] if j == 0 else kinds[ids[j - 1]] for j in range(first, i + 1)]
            total += by_hand(net, x, kinds[ids[i]]) + share[ids[i]]
        want.append(total / np.log(10))
    assert np.allclose(scorer.score(np.concatenate(texts), np.array(list(map(len, texts)))), want, rtol=1e-3)


def test_probabilities_of_all_ids_sum_to_one():
    rng, net = small(2)
    counts = rng.integers(0, 9, 5000).astype(float)
    kinds = lm.classes(counts, np.arange(5000) < 2000)
    assert len(set((kinds[:2000] // lm.MEMBERS).tolist()) & set((kinds[2000:] // lm.MEMBERS).tolist())) == 0
    share = np.log((counts + 0.5) / np.bincount(kinds, weights=counts + 0.5, minlength=lm._PAD)[kinds])
    x = np.tile(rng.integers(0, lm._PAD, lm.PLACES), (lm._PAD, 1))
    y = np.full((lm._PAD, lm.STRIDE), lm._PAD)
    y[:, 0] = np.arange(lm._PAD)
    p = np.exp(net.log_probs(x, y))
    assert abs(p.sum() - 1) < 1e-3
    assert abs((p[kinds] * np.exp(share)).sum() - p[np.unique(kinds)].sum()) < 1e-3


def test_ends_are_targets_and_padding_is_not():
    kinds, lengths = np.arange(1, 76), np.array([40, 1, 34])
    x, y = lm.windows(kinds, lengths, 7)
    assert (y != lm._PAD).sum(1).tolist() == [32, 8, 1, 32, 2]
    assert y[y != lm._PAD].tolist() == kinds.tolist()
    assert (x[0, : lm.CONTEXT] == lm._PAD).all() and x[0, lm.CONTEXT] == 7 and x[2, lm.CONTEXT] == 7
    assert x[1, : lm.CONTEXT + 1].tolist() == kinds[lm.STRIDE - lm.CONTEXT - 1 : lm.STRIDE].tolist()
    chosen = np.array([4, 1, 2])
    for some, whole in zip(lm.some_windows(np.arange(75), lengths, np.append(kinds, 7), 75, chosen), (x, y), strict=True):
        assert (some == whole[chosen]).all()
    rng, net = small(3)
    x, y = x.copy(), y.copy()
    before = net.gradients(x, y)[0]
    x[2, lm.CONTEXT + 1 :] = 5  # what stands in padded places has no effect on what is learned
    for name, g in net.gradients(x, y)[0].items():
        assert np.allclose(g, before[name], atol=1e-7), name


def test_words_are_encoded_alone_and_forgotten():
    memory = lm.Words(public(NAME), END, [b"the", b"cat"], memory=3)
    texts = [b"The cat's  toy.", None, b"\xc3\x89t\xc3\xa9 <|endoftext|> it'll", b"the the zebra", b"a\xc2\xa0b \xc2\xa0 \xc2\xa0\xc2\xa0c d\xc2\xa0 \xe2\x80\x83 '", b"12 3456 'll x\xe3\x80\x80 \x1c !? s"]
    coder = Encoder(public("byte_bpe_50k.json"), special=False).tokenizer
    for _ in range(3):
        if memory.full():
            memory.forget()
            assert memory.words == [b"the", b"cat"]
        ids, lengths = memory.ids(*memory.numbers(pa.array([b"?", *texts], pa.binary()).slice(1)))
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for part, t in zip(parts, texts, strict=True):
            want = [i for w in words((t or b"").decode()) for i in coder.encode(" " + w, add_special_tokens=False).ids]
            assert part.tolist() == [*want, END]


def test_each_window_is_learned_from(spark, monkeypatch):
    """In turns, those of the kept texts at last; a task that holds few windows at once learns from all of them, too."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 400, 900)
    n_windows = int((-(-lengths // lm.STRIDE)).sum())
    for turns in (1, 3):
        found = [lm.turn(np.arange(900), lengths, turns, epoch) for epoch in (0, 1)]
        assert all(len(f) == n_windows and set(f.tolist()) == set(range(turns)) for f in found)
    ids = [np.append((rng.integers(0, 99) + np.arange(n - 1)) % 99, 99) for n in lengths]
    counts = np.bincount(np.concatenate(ids), minlength=100).astype(float)
    bodies = spark.createDataFrame([(i, x.astype("<u2").tobytes()) for i, x in enumerate(ids)], "tag long, ids binary").repartition(3).cache()
    monkeypatch.setattr(lm, "STEPS", 4)
    kinds = lm.classes(counts, np.arange(100) < 50)
    for held in (100, 1 << 18):
        monkeypatch.setattr(lm, "HELD", held)
        weights, losses, learned = lm.train(bodies, kinds, counts, 99, False)
        assert len(learned) == lm.TURNS + 1 and sum(learned) == n_windows and losses[lm.TURNS] < losses[0]
    monkeypatch.setattr(lm, "KEPT", 1 << 30)  # but for one text none is kept
    assert sum(lm.train(bodies, kinds, counts, 99, False)[2]) == n_windows
    monkeypatch.setattr(lm, "STEPS", 400)
    assert lm.train(bodies.where("tag > 0"), kinds, counts, 99, False)[2] == [n_windows - -(-lengths[0] // lm.STRIDE)] * lm.BLIND
