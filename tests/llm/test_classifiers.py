import random
import zlib

import numpy as np

from loreforge.llm import quality, toxicity


def corpus(n=600):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        lines = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 6))]
        if toxic:
            lines[rng.randrange(len(lines))] += " nastyword here"
        rows.append((i, (". " if good else "!!! *** ").join(lines), "s", 1))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, place int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute_noisy_or(model, text):
    p = 1.0
    for sentence in toxicity.split([text])[0]:
        z = model.bias + sum(model.weights[zlib.crc32(f.encode()) % len(model.weights)] for w in toxicity._WORD.findall(sentence.lower()) for f in toxicity.features(w))
        p *= 1 - 1 / (1 + np.exp(-z))
    return 1 - p


def test_toxicity(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    out = {r["doc_id"]: r for r in toxicity.classify(docs, marks).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [r for r in out.values() if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    model = toxicity.train(docs, marks)
    texts = {i: t for i, t, *_ in rows}
    assert all(abs(out[i]["score"] - brute_noisy_or(model, texts[i])) < 1e-6 for i in range(0, 600, 20))
    found = toxicity.locate(docs, model).collect()
    assert np.mean(["nastyword" in r["sentence"] for r in found]) > 0.95
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, marks).collect()} == {i for i, r in out.items() if r["score"] < 0.5}


def test_odd_texts(spark):
    rows, labels = corpus(100)
    odd = [(1000, None, None, None), (1001, "", "", 0), (1002, " \n", "", 0), (1003, "w1. " * 200_000, "", 0), (1003, "w1", "", 0), (None, "w1", "", 0)]
    docs, marks = frames(spark, rows + odd, [*labels, (5, 1, 1), (None, 1, 1), (7, None, None)])
    out = toxicity.classify(docs, marks).collect()
    assert len(out) == 106 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.drop_toxic(docs, marks).columns == docs.columns
    graded = quality.rate(docs, quality.train(docs, marks)).collect()
    assert len(graded) == 106 and all(0 <= r["tail_probability"] <= 1 for r in graded)
    none, unlabelled = frames(spark, [], [])
    for d in (none, docs):
        assert toxicity.classify(d, unlabelled).count() == d.count()
        assert quality.rate(d, quality.train(d, unlabelled)).count() == d.count()


def test_grades(spark):
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 500)
    rows = [(i, " ".join(rng.choice(["good"] * (g + 1) + ["bad"] * (4 - g) + ["x"], 60)), "", 0) for i, g in enumerate(grades.tolist())]
    docs, marks = frames(spark, rows, [(i, g, 0) for i, g in enumerate(grades.tolist())])
    model = quality.train(docs, marks)
    assert len(model.cuts) == 3 and (np.diff(model.cuts) > 0).all()
    out = {r["doc_id"]: r for r in quality.rate(docs, model, least=2).collect()}
    held = [i for i, r in out.items() if r["held_out"]]
    assert np.corrcoef([out[i]["expected_grade"] for i in held], grades[held])[0, 1] > 0.9
    assert np.mean([out[i]["kept"] == (grades[i] >= 2) for i in held]) > 0.85


def test_binary_quality(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    out = [r for r in quality.rate(docs, quality.train(docs, marks)).collect() if r["held_out"]]
    several = {i for i, t, *_ in rows if "." in t or "!" in t}
    assert np.mean([r["kept"] == bool(labels[r["doc_id"]][1]) for r in out if r["doc_id"] in several]) > 0.95


def brute_grades(model, text):
    """The latent value and P(grade >= k) by hand, token by token."""
    tokens = quality._TOKEN.findall(text)
    z = 0.0
    for t in tokens:
        for f in (t.lower(), "~" + quality.shape(t)):
            z += quality.SCALE * float(model.weights[zlib.crc32(f.encode()) % len(model.weights)]) / len(tokens)
    return [1 / (1 + np.exp(c - z)) for c in model.cuts]


def test_grades_by_brute_force(spark):
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 300)
    rows = [(i, " ".join(rng.choice(["Good", "fine1"] * (g + 1) + ["bad,"] * (3 - g) + ["x", "..."], 40)), "", 0) for i, g in enumerate(grades.tolist())]
    docs, marks = frames(spark, rows, [(i, g, 0) for i, g in enumerate(grades.tolist())])
    model = quality.train(docs, marks)
    for least in (1, 2):
        for r in quality.rate(docs, model, least=least).collect():
            above = brute_grades(model, rows[r["doc_id"]][1])
            assert abs(r["expected_grade"] - sum(above)) < 1e-6 and abs(r["tail_probability"] - above[least - 1]) < 1e-6
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["kept"] == (r["tail_probability"] >= 0.5)


def test_the_fit_of_grades_is_the_likelihood_s_maximum(monkeypatch):
    """Small changes of any weight or threshold lower the penalised likelihood that fit() maximises."""
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 200)
    texts = [" ".join(rng.choice(["good"] * (g + 2) + ["bad"] * (4 - g) + ["x"], 12)) for g in grades.tolist()]
    model = quality.fit(texts, grades, steps=3000, rate=0.02, decay=1e-2)

    def loss(m):
        total = 0.0
        for text, g in zip(texts, grades.tolist(), strict=True):
            edges = [1.0, *brute_grades(m, text), 0.0]
            total -= np.log(edges[g] - edges[g + 1])
        return total / len(texts) + 1e-2 / 2 * float((m.weights.astype(float) ** 2).sum())

    best = loss(model)
    places = np.flatnonzero(model.weights)
    for step in (0.03, -0.03):
        for k in places[:6]:
            w = model.weights.astype(float).copy()
            w[k] += step
            assert loss(quality.Model(w, model.cuts)) >= best - 1e-6
        for k in range(2):
            cuts = model.cuts.copy()
            cuts[k] += step
            assert loss(quality.Model(model.weights, cuts)) >= best - 1e-6


def test_clashing_names(spark):
    rows, labels = corpus(120)
    docs, marks = frames(spark, rows, labels)
    docs = docs.selectExpr("doc_id", "text", "1 AS __id", "2 AS __label", "3 AS id", "4 AS label", "5 AS score", "6 AS worst")
    out = toxicity.drop_toxic(docs, marks)
    assert out.columns == docs.columns and 0 < out.count() <= 120
    assert quality.rate(docs, quality.train(docs, marks)).count() == 120


def test_the_fit_of_toxicity_takes_features_in_parts(monkeypatch):
    """No step of the fit looks up all features at once, and parts change nothing but the order of sums."""
    rng = np.random.default_rng(2)
    texts = [". ".join(" ".join(f"w{k}" for k in rng.integers(0, 60, rng.integers(0, 9))) for _ in range(rng.integers(1, 5))) for _ in range(200)] + [""]
    labels, sizes, bincount = np.arange(201) % 3 == 0, [], np.bincount
    whole = toxicity.fit(texts, labels, steps=20)
    monkeypatch.setattr(toxicity, "PART", 50)
    monkeypatch.setattr(np, "bincount", lambda x, *a, **b: sizes.append(len(x)) or bincount(x, *a, **b))
    parts = toxicity.fit(texts, labels, steps=20)
    assert np.allclose(whole.weights, parts.weights, atol=1e-6) and abs(whole.bias - parts.bias) < 1e-9
    assert max(sizes) <= sum(map(len, toxicity.split(texts))) < 600  # of features there are over a thousand
