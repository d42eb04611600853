"""Steps whose shuffles must not grow faster than their input."""

import random
import re
from collections import defaultdict

from loreforge.operators import duplicates, index, search


def test_similar_documents_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "TERMS", 7, raising=False)
    rng = random.Random(3)
    rows = [(i, t, float(rng.randrange(1, 9))) for i in range(1, 90) for t in rng.sample("abcdefghij", rng.randrange(6))]
    terms = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    out = search.similar_docs(terms, terms.where("doc_id % 20 = 0"))
    sums = defaultdict(float)
    for q, t, u in rows:
        for i, s, w in rows:
            if q % 20 == 0 and s == t and q != i:
                sums[q, i] += u * w
    want = set()
    for q in {q for q, _ in sums}:
        best = sorted((-s, i) for (a, i), s in sums.items() if a == q)[:3]
        want |= {(q, i, -s, k) for k, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in out.collect()} == want
    assert "Join Inner" not in out._jdf.queryExecution().optimizedPlan().toString()  # pairs are made and summed in blocks, not joined and shuffled


def test_tokens_are_counted_by_document(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, "B"), (None, "b"), (3, None)], "doc_id long, text string")
    for made, want in ((index.counts(docs), {("a", 1, 3), ("b", 1, 1), ("c", 1, 1), ("b", 2, 1), ("b", None, 1)}), (index.postings(docs).drop("positions"), {("a", 1, 3), ("b", 1, 1), ("c", 1, 1), ("b", 2, 1), ("b", None, 1)})):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange ") == 1  # texts move, tokens don't
        assert {(r["term"], r["doc_id"], r["tf"]) for r in made.collect()} == want


def test_weights_of_rare_and_frequent_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a w{i} v{i // 2}" + " b" * (i % 3)) for i in range(40)], "doc_id long, text string")
    rows = lambda: {tuple(r) for r in search.top_terms(docs).collect()}
    want = rows()
    for most in (0, 1, 3):
        monkeypatch.setattr(search, "FREQUENT", most, raising=False)
        assert rows() == want


def test_queries_meet_documents_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    stored = index.write_index(spark.createDataFrame([(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(9)))) for i in range(60)], "doc_id long, text string"), buckets=3)
    asked = spark.createDataFrame([(q, " ".join(rng.sample("abcdefg", 3))) for q in range(12)] + [(12, None), (None, "a f"), (3, "a b")], "query_id long, text string")
    whole = {fn: {tuple(r) for r in fn(stored, asked, k=4).collect()} for fn in (search.bm25, search.tfidf)}
    monkeypatch.setattr(search, "POSTINGS", 20, raising=False)
    monkeypatch.setattr(search, "ASKED", 9, raising=False)
    for fn, want in whole.items():
        out = fn(stored, asked, k=4)
        assert {tuple(r) for r in out.collect()} == want and len(want) == 13 * 4
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"Aggregate \[query_id#\d+L?, doc_id#", plan)  # pairs are scored in blocks, not shuffled


def test_lists_of_postings_are_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["a", "b", "c"], i * 7) for i in range(500)], "doc_id long, w array<string>, hash long").selectExpr("doc_id", "3L AS dl", "hash", "w").coalesce(2)
    lists = index._packed(docs, {"a": 2})
    assert lists.count() == 2 * 4  # tasks times terms and shards
    rows = index._unpacked(lists.selectExpr("0L AS slot", "*")).collect()
    assert {(r["term"], r["doc_id"], r["tf"], r["dl"], *r["positions"]) for r in rows} == {(t, i, 1, 3, k) for i in range(500) for k, t in enumerate("abc")}
    monkeypatch.setattr(index, "PACK", 1)
    assert {tuple(map(str, r)) for r in index._unpacked(index._packed(docs, {}).selectExpr("0L AS slot", "*")).collect()} == {tuple(map(str, r)) for r in rows}


def test_rarest_shingles_alone_are_shuffled(spark, monkeypatch):
    rng, kept, keep = random.Random(8), {}, duplicates.keep
    base = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{base} " + " ".join(f"x{rng.randrange(10**9)}" for _ in range(64 if i > 1 else 1))) for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(duplicates, "keep", lambda df, what="kept": kept.setdefault(what, []).append(keep(df, what)) or kept[what][-1])
    assert {(r["a"], r["b"]) for r in duplicates.near_duplicates(docs).collect()} == {(0, 1)}
    sizes = [r["n"] for r in kept["sets"][0].collect()]
    assert sorted(sizes) == [37, 37] + [100] * 28
    assert kept["rarest"][0].count() == sum(n - -(-n * 4 // 5) + 1 for n in sizes)  # a fifth of all, found where the sets are
    assert kept["wanted"][0].count() == 2  # no other sets are moved to be compared
