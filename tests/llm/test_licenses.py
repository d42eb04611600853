import random
import re

import pytest

from loreforge.llm import licenses


def brute(text):
    """Templates of which some window of their own length or a little more holds 0.8 of the shingles."""
    words = re.findall(r"[^\W_]+", text.lower())
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = set()
    for name, t in licenses.TEMPLATES.items():
        w = re.findall(r"[^\W_]+", t.lower())
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if any(len(own & set(grams[i : i + len(own)])) >= 0.8 * len(own) for i in range(max(1, len(grams) - len(own) + 1))):
            found.add(name)
    return found


def made(seed):
    rng, out = random.Random(seed), []
    for _ in range(rng.randint(0, 4)):
        t = rng.choice(list(licenses.TEMPLATES.values())).split()
        if rng.random() < 0.5 and len(t) > 20:
            t[rng.randrange(2)] = "changed"
        out += rng.choices("the a of in to license under".split(), k=rng.randint(0, 60)) + t
    return " ".join(out)


def test_against_brute_force(spark):
    rows = [(i, made(i), "x", 1) for i in range(300)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string, n_words int").repartition(3)).collect()
    got = {i: set() for i, *_ in rows}
    for r in out:
        assert r["containment"] >= 0.8
        got[r["doc_id"]].add(r["license"])
    want = {i: brute(t) for i, t, *_ in rows}
    assert all(want[i] <= got[i] for i in want)
    # windows are a little longer than templates, so that a spread-out hit may be found beside
    assert sum(len(got[i] - want[i]) for i in want) <= 3


def test_places_and_odd_texts(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, f"one two {mit} three {mit}"), (2, None), (3, ""), (4, "MIT License"), (5, "w " * 300_000 + mit), (1, mit), (None, mit)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or 0, r["license"], r["first_word"], r["n_words"]) for r in out)
    assert got == [(0, "MIT", 0, 5), (1, "MIT", 0, 5), (1, "MIT", 2, 5), (1, "MIT", 8, 5), (5, "MIT", 300_000, 5)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_templates_of_a_folder(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = {f"License {n}": [rng.choice(words) for _ in range(n)] for n in (40, 160, 800, 3000)}
    for name, t in texts.items():
        (tmp_path / f"{name}.txt").write_text(" ".join(t))
    templates = licenses.read_templates(spark, f"file://{tmp_path}")
    assert templates == {name: " ".join(t) for name, t in texts.items()}
    rows, want = [], {}
    for i in range(80):  # each text somewhere, some with words replaced: near 0.9 of the shingles stay, and near 0.6
        name, spoilt = rng.choice(list(texts)), i % 3
        t = list(texts[name])
        for at in range(3, len(t), 50 if spoilt == 1 else 12):
            t[at] = "other" if spoilt else t[at]
        before = [rng.choice(words) for _ in range(rng.randrange(400))]
        rows.append((i, " ".join(before + t + [rng.choice(words) for _ in range(rng.randrange(400))])))
        if spoilt < 2:
            want[i] = (name, len(before), len(t))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {i: name for i, (name, _, _) in want.items()} and len(got) == len(want)
    for r in got:
        _, first, n = want[r["doc_id"]]
        assert r["first_word"] >= first and r["first_word"] + r["n_words"] <= first + n and (r["doc_id"] % 3 or (r["first_word"], r["n_words"], r["containment"]) == (first, n, 1.0))
    with pytest.raises(ValueError, match="at most"):
        licenses.read_templates(spark, f"file://{tmp_path}", most=100)


def test_a_whole_text_holds_its_notice():
    found = {name for name, *_ in licenses.Scanner().scan("Copyright\n" + licenses.TEMPLATES["MIT-whole"].upper() + "\nint main() { return 0; }")}
    assert found == {"MIT-whole", "MIT-text"}
