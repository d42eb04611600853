"""The registered queries, each over its whole tables, and the SQL that gives the same rows."""

from pyspark.sql import functions as F

from ..functions import user
from ..operators import catalogue, cleaning, duplicates, index, knowledge, search, usage
from ..sources.tables import load, shared
from ..streaming import streams
from .oracles import ORACLES  # noqa: F401


def _of(fn, *tables):
    """A query: fn on the named tables."""
    return lambda spark, d: fn(*[load(spark, d, t) for t in tables])


def _passages(benchmark):
    return benchmark.select(F.col("item_id").alias("query_id"), "text")


def _asked(df, id_col="vec_id"):
    """The rows that searches take as queries."""
    return df.where(F.col(id_col) % 20 == 0)


_indexes: dict = {}


def _index_of(spark, d):
    """The stored index of a folder's documents: written at first, then opened by all queries of the session, as long as the files are the same."""
    documents = load(spark, d, "documents")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def changed(file):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        return path.getFileSystem(hadoop).getFileStatus(path).getModificationTime()

    files = sorted(documents.inputFiles())
    key = (spark.sparkContext.applicationId, tuple(files), tuple(map(changed, files)))
    if key not in _indexes:
        _indexes[key] = index.write_index(documents).path
    return index.Index(spark, _indexes[key])


def _with_index(fn, *tables):
    """A query: fn on the index of documents and on the named tables."""
    return lambda spark, d: fn(_index_of(spark, d), *[load(spark, d, t) for t in tables])


def _bm25(found, benchmark):
    return search.bm25(found, _passages(benchmark))


def _fused(found, benchmark):
    return search.fuse([_bm25(found, benchmark), search.tfidf(found, _passages(benchmark))])


def _evaluate(found, documents, benchmark):
    relevant = duplicates.contains_passage(documents, benchmark).withColumnRenamed("item_id", "query_id")
    return search.evaluate(_bm25(found, benchmark), relevant)


def _turns(found, conversations):
    asked = _asked(usage.qa_pairs(conversations), "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("question").alias("text"))
    return search.bm25(found, asked, k=3)


def _phrase(found):
    return search.phrase_search(found, found.spark.createDataFrame([(0, "of the")], "query_id long, text string")).drop("query_id")


def _index(spark, d):
    stored = index.write_index(load(spark, d, "documents"))
    return stored.postings.groupBy(F.substring(F.md5("term"), 1, 1).alias("bucket")).agg(F.count_distinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"))


def _stream(fn, mode="append"):
    def run(spark, d):
        out = streams.drain(fn(streams.replay(load(spark, d, "events"))), mode)
        return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in out.dtypes])

    return run


def _documents_stream(spark, d):
    return streams.stream_index(spark.readStream.schema(load(spark, d, "documents").schema).parquet(_copied(spark, d)))


def _copied(spark, d):
    path = shared(spark, "documents")
    load(spark, d, "documents").write.parquet(path)
    return path


def _user_fn(spark, d):
    fn = user.register_fn(spark, "vowels", lambda s: s.fillna("").str.count("[aeiouAEIOU]").astype("int64"), "bigint")
    return load(spark, d, "documents").select("doc_id", fn("text").alias("n_vowels"))


class _Lines:
    def eval(self, text: str):
        for n, line in enumerate((text or "").split("\n")):
            yield n, line


def _user_table_fn(spark, d):
    user.register_table_fn(spark, "text_lines", _Lines, "n int, line string")
    load(spark, d, "documents").createOrReplaceTempView("__documents")
    return spark.sql("SELECT doc_id, CAST(n AS BIGINT) AS n, line FROM __documents, LATERAL text_lines(text)")


def _user_agg(spark, d):
    """The least and the largest value of each user, as a state that tasks merge."""

    def update(state, values):
        return (min(state[0], values.min()), max(state[1], values.max())) if values.notna().any() else state

    inf = float("inf")
    return user.two_step_agg(
        load(spark, d, "events").select("user_id", "value"), ["user_id"], "value", lambda: (inf, -inf), update, lambda a, b: (min(a[0], b[0]), max(a[1], b[1])),
        lambda s: round(float(s[1] - s[0]), 6) if s[0] <= s[1] else None, "value_range", "double",
    )


def _positions(documents):
    return index.postings(documents).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def _term_stats(documents):
    return index.term_stats(index.counts(documents)).join(F.broadcast(index.corpus_stats(documents))).select("term", "df", "cf", "n", F.round("mean_length", 6).alias("mean_length"))


QUERIES = {
    "k01_load": _of(lambda c: c, "conversations"),
    "k02_canonical_pages": _of(catalogue.canonical_pages, "pages"),
    "k03_page_text": _of(catalogue.page_text, "pages"),
    "k04_page_links": _of(catalogue.page_links, "pages"),
    "k05_catalogue": _of(catalogue.catalogue, "documents"),
    "k06_find_docs": _of(lambda d: catalogue.find_docs(d, "en", "src1", 100, 20), "documents"),
    "k07_length_stats": _of(catalogue.length_stats, "documents"),
    "k08_quality_measures": _of(cleaning.quality_measures, "documents"),
    "k09_find_pii": _of(cleaning.find_pii, "documents"),
    "k10_mask_pii": _of(cleaning.mask_pii, "documents"),
    "k11_repeated_lines": _of(cleaning.repeated_lines, "documents"),
    "k12_drop_repeated_lines": _of(lambda d: cleaning.drop_repeated_lines(d, cleaning.repeated_lines(d)), "documents"),
    "k13_exact_duplicates": _of(duplicates.exact_duplicates, "documents"),
    "k14_near_duplicates": _of(duplicates.near_duplicates, "documents"),
    "k15_near_duplicates_lsh": _of(duplicates.near_duplicates_lsh, "documents"),
    "k14_near_duplicate_classes": _of(duplicates.near_duplicate_classes, "documents"),
    "k16_duplicate_clusters": _of(duplicates.document_clusters, "documents"),
    "k17_contains_passage": _of(duplicates.contains_passage, "documents", "benchmark"),
    "k18_chunk": _of(index.chunk, "documents"),
    "k19_postings": _of(_positions, "documents"),
    "k20_term_stats": _of(_term_stats, "documents"),
    "k21_write_index": _index,
    "k22_boolean_search": _with_index(lambda i: search.boolean_search(i.lookup(["the", "tion", "this", "that", "was"]), ["the"], ["tion", "this", "that"], ["was"])),
    "k23_bm25": _with_index(_bm25, "benchmark"),
    "k24_top_terms": _of(search.top_terms, "documents"),
    "k25_phrase_search": _with_index(_phrase),
    "k26_knn": _of(lambda v: search.knn(v, _asked(v)), "embeddings"),
    "k27_knn_lsh": _of(lambda v: search.knn_lsh(v, _asked(v)), "embeddings"),
    "k28_knn_filtered": _of(lambda v: search.knn(v.where("label = 3"), _asked(v)), "embeddings"),
    "k29_fuse": _with_index(_fused, "benchmark"),
    "k30_similar_docs": _of(lambda d: search.similar_docs(search.top_terms(d), _asked(d, "doc_id")), "documents"),
    "k31_evaluate": _with_index(_evaluate, "documents", "benchmark"),
    "k32_label_rates": _of(knowledge.label_rates, "documents", "labels"),
    "k33_unlabelled": _of(knowledge.unlabelled, "documents", "labels"),
    "k34_cooccurrence": _of(knowledge.cooccurrence, "documents"),
    "k35_centroids": _of(knowledge.centroids, "embeddings"),
    "k36_knn_label": _of(lambda v: knowledge.knn_label(search.knn(v, _asked(v)), v), "embeddings"),
    "k37_quality_model": _of(knowledge.quality_model, "documents", "labels"),
    "k38_threads": _of(usage.threads, "conversations"),
    "k39_qa_pairs": _of(usage.qa_pairs, "conversations"),
    "k40_retrieve_for_turns": _with_index(_turns, "conversations"),
    "k41_usage_tumbling": _of(usage.usage_tumbling, "events"),
    "k42_usage_sliding": _of(usage.usage_sliding, "events"),
    "k43_sessions": _of(usage.sessions, "events"),
    "k44_running_usage": _of(usage.running_usage, "events"),
    "k45_funnel": _of(usage.funnel, "events"),
    "k46_usage_by_prop": _of(usage.usage_by_prop, "events"),
    "k47_active_users_approx": _of(usage.active_users_approx, "events"),
    "k48_stream_usage": _stream(streams.stream_usage),
    "k49_stream_sessions": _stream(streams.stream_sessions),
    "k50_stream_dedup": _stream(streams.stream_dedup),
    "k51_stream_view_purchase": _stream(streams.stream_view_purchase),
    "k52_stream_user_state": _stream(streams.stream_user_state),
    "k53_stream_index": _documents_stream,
    "k54_register_fn": _user_fn,
    "k55_register_table_fn": _user_table_fn,
    "k56_register_agg": _user_agg,
}
