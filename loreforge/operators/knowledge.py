"""Knowledge from texts, labels and vectors."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.tables import keep


def label_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "source").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


def unlabelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.select("doc_id").join(labels, "doc_id", "left_anti")


def cooccurrence(documents: DataFrame, min_share: float = 0.1) -> DataFrame:
    """a, b, n, pmi: pairs of terms that are found together in min_share of all documents or more, a < b, anywhere in their texts.

    Terms of fewer documents can't be in such a pair and go first. Those left are at most the mean number of a document's terms over min_share,
    however many documents there are; they are counted by number, each task's counts before the shuffle. Each row is a document, and one without text counts.
    """
    rows = keep(documents.select(F.monotonically_increasing_id().alias("row"), F.array_distinct(F.coalesce(tokens("text"), F.array().cast("array<string>"))).alias("w")), "tokens")
    total = rows.count()
    each = rows.select("row", F.explode("w").alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_share * total)
    often = keep(df.withColumn("id", F.monotonically_increasing_id()), "often")
    own = each.join(F.broadcast(often.select("term", "id")), "term").groupBy("row").agg(F.collect_list("id").alias("ids"))
    one = own.select("ids", F.posexplode("ids").alias("at", "x")).select("x", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("y"))
    pairs = one.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_share * total)
    of = lambda side: F.broadcast(often.select(F.col("id").alias(side), F.col("term").alias(f"{side}_term"), F.col("df").alias(f"{side}_df")))
    found = pairs.join(of("x"), "x").join(of("y"), "y")
    pmi = F.log(F.col("n").cast("double") * total / (F.col("x_df").cast("double") * F.col("y_df")))
    return found.select(F.least("x_term", "y_term").alias("a"), F.greatest("x_term", "y_term").alias("b"), "n", F.round(pmi, 6).alias("pmi"))


def centroids(vectors: DataFrame) -> DataFrame:
    each = vectors.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return each.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(F.round(F.avg("x"), 6).alias("mean"))


def knn_label(neighbours: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, label, votes: the most frequent label of the neighbours, the smallest of equals."""
    votes = neighbours.join(vectors.select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    first = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return votes.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def quality_model(documents: DataFrame, labels: DataFrame, features: int = 1 << 16) -> DataFrame:
    """doc_id, probability of good quality, from the shares that tokens and runs of marks have of a text.

    Fitted on the labelled documents, by Spark's own distributed regression. Null texts count as empty, and without labels all probabilities are null."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    marks = F.transform(F.regexp_extract_all("text", F.lit(r"[^\p{L}\p{N} ]+"), F.lit(0)), lambda m: F.substring(m, 1, 4))
    rows = documents.select("doc_id", F.coalesce(F.concat(tokens("text"), marks), F.array().cast("array<string>")).alias("w"))
    steps = [HashingTF(inputCol="w", outputCol="tf", numFeatures=features), Normalizer(inputCol="tf", outputCol="x", p=1.0), LogisticRegression(featuresCol="x", labelCol="quality", maxIter=60, regParam=1e-5, standardization=False)]
    known = rows.join(labels.where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id")
    if known.isEmpty():
        return rows.select("doc_id", F.lit(None).cast("double").alias("probability"))
    model = Pipeline(stages=steps).fit(known)
    return model.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("probability"))
