import random

import pytest
from pyspark.sql import functions as F

from loreforge.llm import mixing


def levels(sizes, weights, share, most):
    """The targets by repeated sharing."""
    left, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        over = {i for i in free if left * weights[i] / sum(weights[j] for j in free) >= most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / sum(weights[j] for j in free)
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = sorted({chr(rng.randrange(65, 0x3000)) for _ in range(9)}) + [None]
    sizes = [rng.choice([0, 5, 80, 3000]) + rng.randrange(9) for _ in names]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (3, 1, 2), 1.5, 2).collect()}
    want = levels(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    assert [got[n] for n in names] == pytest.approx(want)


def docs(spark):
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    return spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w\n"), (F.col("id") % 29).cast("int")).alias("text"), source.alias("source"), F.lit(1).alias("size"))


def test_near_targets_and_reruns_agree(spark):
    out = mixing.mix(docs(spark))
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert rows == sorted(mixing.mix(docs(spark).repartition(7)).collect(), key=lambda r: r["doc_id"])
    assert len(rows) == 3000 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 15


def test_inclusion_follows_the_probabilities(spark):
    """Over many seeds, a document is taken as often as its size says, and sizes differ in that within a source."""
    frame, n = docs(spark).where("doc_id < 600"), 12
    copies, size = {}, {}
    for seed in range(n):
        for r in mixing.mix(frame, seed=f"s{seed}").collect():
            copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
            size[r["doc_id"]] = r["size"]
            assert 0 <= r["p"] < 1 and 0 <= r["copies"] <= 2
    hot = [i for i in copies if i % 3 == 0]
    small, large = ([copies[i] / n for i in hot if low <= size[i] <= high] for low, high in ((1, 4), (22, 28)))
    assert sum(large) / len(large) > 1.5 * sum(small) / len(small)
    first = {r["doc_id"]: r for r in mixing.mix(frame, seed="s0").collect()}
    by_size = {}
    for i in hot:
        by_size.setdefault(size[i], []).append(copies[i] / n)
    for s, rates in by_size.items():  # the mean over documents of one size and over seeds is near whole copies and p
        r = next(first[i] for i in hot if size[i] == s)
        whole = {k for k in range(3) if all(k <= c <= k + 1 for c in rates)}
        want = [k + r["p"] for k in whole]
        assert s == 0 or not want or min(abs(sum(rates) / len(rates) - w) for w in want) < 0.2


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_sizes(spark, seed):
    """Expected copies rise with the root of the size, stop at two, and add up to the target."""
    rng = random.Random(seed)
    rows = [("a", s) for s in (rng.choice([1, 5, 9, 40, 3000]) for _ in range(200))] + [("b", 0), ("b", 7), ("c", 0)]
    goal = rng.choice([0.1, 0.9, 1.7, 2.0])
    sizes = spark.createDataFrame(rows, "source string, size long")
    total = {s: sum(n for t, n in rows if t == s) for s in "abc"}
    goals = spark.createDataFrame([(s, n, goal * n) for s, n in total.items()], "source string, source_size long, target double")
    out = {(r["source"], r["size"]): r["whole"] + r["p"] for r in mixing.expected(sizes, goals, 2).collect()}
    for s in "ab":
        assert sum(out[s, n] * n for t, n in rows if t == s) == pytest.approx(goal * total[s])
    own = sorted((n, c) for (s, n), c in out.items() if s == "a")
    for (n, c), (m, d) in zip(own, own[1:], strict=False):
        assert d == 2 or d / c == pytest.approx(int(16 * m**0.5) / int(16 * n**0.5))
    assert out["c", 0] == 0


def test_clashing_names_and_reserved_columns(spark):
    frame = docs(spark).where("doc_id < 200").select("*", *[F.lit(1).alias(c) for c in ("__id", "__copies", "__rows", "__each", "__copy", "weight", "p", "target")])
    out = mixing.mixed(frame)
    assert out.columns == frame.columns and out.count() > 0


def test_mixed_rows(spark):
    frame = docs(spark)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(frame).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixing.mixed(frame).groupBy("doc_id").count().collect()}
    assert mixing.mixed(frame).columns == frame.columns
    assert counts == {i: n for i, n in copies.items() if n}


def test_nulls_empty_and_repeats(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    only_null = mixing.mix(spark.createDataFrame([(1, None, None), (None, "", None)], schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only_null] == [(0, 0.0, 0)] * 2
    rows = [(1, "a b c", "x")] * 4 + [(2, "a " * 50_000, "y"), (None, "b", "x"), (None, "b", None)]
    frame = spark.createDataFrame(rows, schema)
    out = mixing.mix(frame)
    assert out.count() == len(rows)
    taken = out.agg(F.sum("taken")).first()[0]
    assert taken == sum(len(r["text"].split()) for r in mixing.mixed(frame).collect())
