"""The stored index: its postings, its plans, hot terms in shards, restarts, phrases and odd rows, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from loreforge.operators import index, search

RNG = random.Random(7)
VOCABULARY = ["a", "b", "c", "d", "e", "rare", "that"]
DOCS = [(i, " ".join(RNG.choice(VOCABULARY[:5]) for _ in range(RNG.randrange(40)))) for i in range(300)] + [(900, "That that THAT, that"), (901, "rare a b rare a b rare"), (902, None), (903, ""), (904, ". ,"), (905, "x " * 20_000 + "end")]
SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module", params=[(1 << 20, 1), (7, 5)])
def stored(spark, request):
    """With all terms whole in one bucket, and with all but rare ones in shards over five."""
    before, index.SHARD = index.SHARD, request.param[0]
    yield index.write_index(spark.createDataFrame(DOCS, SCHEMA), buckets=request.param[1])
    index.SHARD = before


def test_postings(stored):
    got = {(r["term"], r["doc_id"]): (r["tf"], r["dl"], r["positions"]) for r in stored.postings.collect()}
    want = {}
    for i, text in DOCS:
        places = defaultdict(list)
        for k, w in enumerate(words(text)):
            places[w].append(k)
        want |= {(w, i): (len(v), len(words(text)), v) for w, v in places.items()}
    assert got == want and stored.n == len(DOCS)
    df = Counter(w for w, _ in want)
    terms = {r["term"]: r for r in stored.terms.collect()}
    assert {t: (r["df"], r["cf"]) for t, r in terms.items()} == {w: (n, sum(v[0] for k, v in want.items() if k[0] == w)) for w, n in df.items()}
    slots = stored.postings.select("term", "slot").distinct().groupBy("term").count().collect()
    assert all(r["count"] <= terms[r["term"]]["shards"] and (terms[r["term"]]["shards"] > 1) == (stored.buckets == 5 and df[r["term"]] > 7) for r in slots)


def test_scores(spark, stored):
    asked = [(1, "rare e"), (2, "that"), (3, None), (4, "none such"), (5, "a b a")]
    rows = search.bm25(stored, spark.createDataFrame(asked, "query_id long, text string"), k=400).collect()
    tf = {i: Counter(words(t)) for i, t in DOCS}
    df, n, mean = Counter(w for c in tf.values() for w in c), len(DOCS), sum(c.total() for c in tf.values()) / len(DOCS)
    want = {}
    for q, text in asked:
        for i, c in tf.items():
            parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in set(words(text)) if c[w]]
            if parts:
                want[q, i] = sum(parts)
    assert {(r["query_id"], r["doc_id"]) for r in rows} == set(want) and all(abs(r["score"] - want[r["query_id"], r["doc_id"]]) < 2e-6 for r in rows)


def test_phrases(spark, stored):
    phrases = ["a", "a b", "a b c", "that that", "that that that", "rare a b rare", "e d c b a", "x end", "none such", "", None, "a none", "b a b a"]
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): (r["n_matches"], r["first_pos"]) for r in search.phrase_search(stored, asked).collect()}
    want = {}
    for q, phrase in enumerate(phrases):
        p = words(phrase)
        for i, text in DOCS:
            w = words(text)
            at = [k for k in range(len(w) - len(p) + 1) if p and w[k : k + len(p)] == p]
            if at:
                want[q, i] = (len(at), at[0])
    assert got == want


def test_plans(spark, stored):
    asked = spark.createDataFrame([(1, "rare e")], "query_id long, text string")
    plan = search.bm25(stored, asked)._jdf.queryExecution().toString()
    assert "split(" not in re.sub(r"split\(lower\(text#\d+\)", "", plan)  # the queries' texts alone are tokenised
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else plans don't tell, but files are left out all the same
    try:
        one = stored.lookup(["rare"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert f"SelectedBucketsCount: 1 out of {stored.buckets}" in one
    assert {r["doc_id"] for r in stored.lookup(["rare"]).collect()} == {901} and stored.lookup([]).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = stored.hits(search.query_terms(asked), "doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("SortMergeJoin") :]
    scan = min(k for k in (side.find("_postings"), len(side)) if k >= 0)
    assert "Exchange" not in side[:scan]  # the postings aren't shuffled


def test_opened_again(spark, stored):
    for what in ("postings", "terms"):
        spark.sql(f"DROP TABLE {index._table(stored.path, what)}")  # what another session doesn't know; the files stay
    again = index.Index(spark, stored.path)
    assert (again.n, again.buckets) == (stored.n, stored.buckets) and again.postings.count() == again.terms.selectExpr("sum(df)").first()[0] > 0


def test_repeated_and_missing_ids(spark):
    found = index.write_index(spark.createDataFrame([(1, "a b"), (1, "a c d"), (None, "a"), (2, "a")], SCHEMA))
    rows = {(r["term"], r["doc_id"]): (r["tf"], r["dl"]) for r in found.postings.collect()}
    assert rows == {("a", 1): (2, 5), ("b", 1): (1, 5), ("c", 1): (1, 5), ("d", 1): (1, 5), ("a", 2): (1, 1)}
    assert found.n == 2 and found.mean_length == 3
    empty = index.write_index(spark.createDataFrame([], SCHEMA))
    assert empty.n == 0 and search.bm25(empty, spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0
