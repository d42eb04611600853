import corpus_pipeline
from loreforge.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.freeze(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    texts = [r["text"] for r in seen["exact_dedup"].select("text").collect()]
    bare = ["".join((t or "").split()) for t in texts]
    assert len(set(bare)) == len(bare)
    ids = lambda name: {r["doc_id"] for r in seen[name].select("doc_id").collect()}
    assert ids("packing") == ids("mixing") <= ids("simhash_near_dedup") <= ids("exact_dedup") <= ids("toxicity")
    rows = seen["packing"].select("sequence_id", "offset", "length").collect()
    ends = {}
    for r in sorted(rows):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_odd_rows_through_the_whole_pipeline(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, and an empty table."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = [(None, None, None, None, None), (9001, None, "en", None, 0), (9002, "", None, "src1", None), (9003, " \n", "en", "src1", 2), (9004, "long text " * 30_000, "en", "src1", 1), (9005, "again and again", "de", "src2", 3), (9005, "again and again", "de", "src2", 3)]
    odd += [(9100 + i, "a b c d e f g h i j k l m n o p q r s t u v w x" + " end" * (i % 2), "en", None, i) for i in range(6)]
    for name, frame in (("full", docs.unionByName(spark.createDataFrame(odd, docs.schema))), ("none", docs.limit(0))):
        more = frame.selectExpr("*", "1 AS __id", "2 AS __copies", "'x' AS __row", "3 AS __gone", "4 AS digest", "5 AS label")
        more.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        frame = table(spark, f"file://{tmp_path}/{name}", "documents")
        stages = dict(corpus_pipeline.STAGES)
        for stage in ("toxicity", "exact_dedup", "simhash_near_dedup", "mixing"):
            frame = corpus_pipeline.freeze(stages[stage](spark, frame, f"file://{tmp_path}/{name}"), stage)
            assert frame.columns == more.columns
            if stage == "simhash_near_dedup" and name == "full":
                left = [r["doc_id"] for r in frame.select("doc_id").collect()]
                assert left.count(9005) == 1 and sum(i is not None and 9100 <= i < 9106 for i in left) == 1
                assert sum(i in (9001, 9002, 9003, None) for i in left) == 1 and 9004 in left
        assert corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").count() >= frame.count()
