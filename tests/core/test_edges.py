"""Hand-made rows: nulls, empty tables, ties, repeats, texts of delimiters alone, restarts."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loreforge.functions.text import PATTERNS
from loreforge.operators import catalogue, cleaning, duplicates, index, knowledge, search, usage
from loreforge.plans import registry
from loreforge.sources.tables import SCHEMAS, load
from loreforge.streaming import streams

ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " .,; \n", "en", "s", 6), (4, "one two", "en", "s", 7), (5, "One, two!", "en", "s", 9), (6, "Élan élan vital, mañana por la mañana", "fr", "s", 36), (7, "Élan élan vital, mañana por la mañana", "fr", "t", 36), (8, "Élan élan vital, mañana por la mañana sí", "fr", "t", 39)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMAS["documents"])


def test_every_query_on_empty_tables(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name in registry.QUERIES:
        out = registry.QUERIES[name](spark, f"file://{tmp_path}").count()
        assert out == 0 or name in ("k05_catalogue", "k31_evaluate", "k45_funnel"), name


def test_classes_hold_every_document(odd):
    rows = {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"]) for r in duplicates.near_duplicate_classes(odd).collect()}
    assert rows == {1: (1, 3, 0), 2: (1, 3, 0), 3: (1, 3, 0), 4: (4, 2, 0), 5: (4, 2, 0), 6: (6, 2, 0), 7: (6, 2, 0), 8: (8, 1, 0)}
    more = odd.unionByName(odd.where("doc_id = 8").select((F.col("doc_id") + 1).alias("doc_id"), F.concat("text", F.lit(" no no no no no no no no no no")).alias("text"), "lang", "source", "n_chars"))
    more = more.unionByName(more.where("doc_id = 9").select(F.lit(10).cast("long").alias("doc_id"), F.concat("text", F.lit(" x")).alias("text"), "lang", "source", "n_chars"))
    clusters = {r["node"]: r["cluster"] for r in duplicates.document_clusters(more).collect()}
    assert clusters == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 9: 9, 10: 9}


def test_minhash_finds_what_the_exact_join_finds(spark):
    docs = load(spark, "/root/testdata/sf0.1", "documents").where("doc_id < 4000")
    exact = {(r["a"], r["b"]) for r in duplicates.near_duplicates(docs).collect()}
    found = {(r["a"], r["b"]) for r in duplicates.near_duplicates_lsh(docs).collect()}
    assert len(exact) > 5 and len(found & exact) >= 0.9 * len(exact) and len(found - exact) <= 0.05 * len(exact) + 1


def test_passages_of_any_length(spark):
    rng, words = random.Random(1), ["a", "bb", "c.", "dd", "e"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(80)] + [None, "", " "]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9) for _ in range(3)] + [None, "", "zzz", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    want = {(i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if p and t and p in t}
    assert {tuple(r) for r in duplicates.contains_passage(docs, items).collect()} == want


def test_secrets_and_addresses_are_masked(spark):
    text = 'token = "0123456789abcdef" at 10.0.0.12 or me@x.org; PASSWORD: hunter22hunter, +1 (555) 123-4567, 4111 1111 1111 1111, DE44 5001 0517 5407 3249 31, -----BEGIN RSA PRIVATE KEY-----\nMIIC+/=\n-----END RSA PRIVATE KEY-----'
    docs = spark.createDataFrame([(1, text), (2, None), (3, "the token was lost; version 1.2.3")], "doc_id long, text string")
    kinds = {(r["doc_id"], r["kind"]): r["n"] for r in cleaning.find_pii(docs).collect()}
    assert {k for d, k in kinds if d == 1} == set(PATTERNS) and kinds[1, "secret"] == 2 and not any(d == 3 for d, _ in kinds)
    masked = {r["doc_id"]: r["text"] for r in cleaning.mask_pii(docs).collect()}
    assert masked[2] is None and masked[3] == "the token was lost; version 1.2.3"
    assert not any(x in masked[1] for x in ("abcdef", "hunter", "10.0.0", "me@x", "4111", "MIIC", "5001"))


def test_search_ties_and_nulls(spark, odd):
    asked = spark.createDataFrame([(1, "one two"), (2, None), (3, ".."), (4, "absent")], "query_id long, text string")
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in search.bm25(index.write_index(odd), asked).orderBy("rank").collect()] == [(1, 4, 1), (1, 5, 2)]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in search.knn(vectors, vectors.where("vec_id = 0"), k=5).orderBy("rank").collect()] == [1, 2]


def test_cleaning_and_counts_of_odd_texts(odd):
    out = {r["doc_id"]: r["n_tokens"] for r in cleaning.quality_measures(odd).collect()}
    assert out[2] == out[3] == 0 and out[5] == 2 and len(out) == len(ODD)
    assert cleaning.drop_repeated_lines(odd, cleaning.repeated_lines(odd)).count() == len(ODD)
    assert {r["term"] for r in index.counts(odd).collect()} == {"one", "two", "élan", "vital", "mañana", "por", "la", "sí"}
    assert {r["doc_id"] for r in index.chunk(odd).collect()} == {3, 4, 5, 6, 7, 8}
    assert knowledge.cooccurrence(odd, min_share=0.2).where("a = 'one'").first()["n"] == 2
    assert {(r["a"], r["b"]): r["n"] for r in knowledge.cooccurrence(odd, min_share=0.3).collect()} == {p: 3 for p in combinations(sorted({"élan", "vital", "mañana", "por", "la"}), 2)}
    assert catalogue.length_stats(odd).count() == 3


def test_a_gap_of_exactly_thirty_minutes(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    events = spark.createDataFrame([(1, at(0)), (1, at(30)), (2, at(5)), (2, at(36))], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r["user_id"], r["n"]) for r in usage.sessions(events).collect()) == [(1, 2), (2, 1), (2, 1)]


def test_approximate_users_are_near_the_true_number(spark):
    events = load(spark, "/root/testdata/sf0.1", "events")
    exact = events.groupBy(F.window("ts", "1 day").start.alias("day")).agg(F.count_distinct("user_id").alias("n"))
    for r in usage.active_users_approx(events).join(exact, "day").collect():
        assert abs(r["users"] - r["n"]) <= 0.08 * r["n"] + 1  # four times the standard error


def test_learned_quality_agrees_with_labels_kept_apart(spark):
    docs, labels = (load(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    kept = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = knowledge.quality_model(docs, labels.where(~kept)).join(labels.where(kept), "doc_id").select("probability", "quality").collect()
    good, bad = ([r["probability"] for r in out if r["quality"] == q] for q in (1, 0))
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))  # the area under the curve
    assert len(out) > 300 and above > 0.85


def test_an_index_kept_up_by_a_stream_survives_a_restart(spark, tmp_path):
    path, place = f"file://{tmp_path}/index", f"file://{tmp_path}/docs"
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(place)
    rows = lambda out: {(r["term"], r["doc_id"], r["tf"]) for r in out.collect()}
    put = lambda *docs: spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.mode("append").parquet(place)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(place)
    assert rows(streams.stream_index(stream(), path)) == set()
    put((1, "old text"), (2, "two two"))
    assert rows(streams.stream_index(stream(), path)) == {("old", 1, 1), ("text", 1, 1), ("two", 2, 2)}
    put((1, "new"), (3, None))
    want = {("new", 1, 1), ("two", 2, 2)}
    assert rows(streams.stream_index(stream(), path)) == want  # another query, with what the first one left
    put((2, ""))
    assert rows(streams.stream_index(stream(), path)) == {("new", 1, 1)}
    assert rows(streams.stream_index(stream(), path)) == {("new", 1, 1)}  # nothing new
