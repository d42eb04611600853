from pyspark.sql import functions as F

from loreforge.llm import exact_dedup
from loreforge.llm.common import BLANKS

ROWS = [(1, "a b"), (2, "ab"), (3, None), (4, " \n"), (5, "a  b"), (6, "A b"), (7, "a\tb "), (None, "ab"), (8, "x y"), (9, "xy"), (10, "long " * 40_000)]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in BLANKS), []).append((-len(t or ""), 2**63 if i is None else i, i))
    return {(i, min(g)[2], len(g), i == min(g)[2]) for g in groups.values() for _, _, i in g}


def found(df):
    return {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()}


def test_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert found(exact_dedup.copies(docs)) == expected(ROWS)


def test_digests_that_collide(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    same = lambda content: F.lit("one")
    assert found(exact_dedup.copies(docs, digest=same)) == expected(ROWS)


def test_hot_group_and_ties(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    out = exact_dedup.copies(docs)
    assert out.where("kept").count() == 2001
    assert {tuple(r) for r in out.where("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(0, 1000)}


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, content string, digest int, n_chars long"
    assert exact_dedup.copies(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", "x", 1, 1), (1, "a", "x", 1, 1), (1, "b", "y", 2, 1), (2, "a ", "z", 3, 2), (None, "c", None, None, None), (None, "c", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    assert exact_dedup.copies(docs).where("kept").count() == 3
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([rows[2], rows[3], rows[4]], schema).collect()))


def test_clashing_names(spark):
    rows = [(1, "a", 1), (2, "a ", 2), (3, "b", 3)]
    for more in ([], [(3, "b ", 4)]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, v int").select("*", *[F.lit("x").alias(c) for c in ("__id", "__digest", "__chars", "kept", "tag", "id", "digest", "again", "keep_id")])
        out = exact_dedup.drop_copies(docs)
        assert out.columns == docs.columns and sorted(r["v"] for r in out.collect()) in ([1, 3], [2, 3], [2, 4])


def test_shuffled_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr("loreforge.llm.common.SMALL", 0)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert found(exact_dedup.copies(docs)) == expected(ROWS)
    assert sorted(map(str, exact_dedup.drop_copies(docs).select("doc_id").collect())) == sorted(f"Row(doc_id={i})" for i, _, _, k in expected(ROWS) if k)
