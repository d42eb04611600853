"""Exact deduplication without Python: local, salted and global stages that all compare full contents.

Texts are equal when they are identical once every blank is deleted. Of equal texts the row with the
most code points in its original text stays, then the smallest id.

First every row's digest is taken. A text whose digest no other row has is no copy, and its content never moves. The
others go through three stages. Stage 1 is the map-side half of the first aggregation: every task folds its own copies.
Stage 2 merges what the tasks send, dealt by digest, salt and content, so that a group of copies which holds a third
of all rows is spread over ``salts`` tasks and over all digests' partitions. Stage 3 joins the salts'
winners. All three group by the content itself beside its digest; a digest alone decides nothing: if two
contents ever share one, the members are matched with their groups by content as well.

Null texts count as empty, and all texts of blanks alone are equal to them. Null ids lose ties, and a
group of null ids has a null keep_id. Of rows that repeat both id and length, one stays. An empty table
gives an empty result. Columns of any other name pass through :func:`drop_copies` untouched.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeze, fresh, small, without_blanks


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """One row per row of docs: <id_col>, keep_id, group_size, kept, digest, n_chars.

    digest: content column -> string column.
    """
    content = without_blanks(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"), content.alias("content")
    ).withColumn("digest", digest(F.col("content")))
    tag = F.monotonically_increasing_id().alias("tag")
    members = freeze(rows.select("id", "n_chars", "digest", tag), "members")
    shared = freeze(members.groupBy("digest").count().where("count > 1").select("digest"), "shared")
    #: Larger for more code points, then for a smaller id.
    order = F.col("n_chars").cast("decimal(38,0)") * F.lit(Decimal(2**64)) - F.coalesce("id", F.lit(2**63 - 1)).cast("decimal(20,0)")
    salted = (
        rows.join(small(shared), "digest", "left_semi")
        .select("digest", "content", "id", "n_chars", F.pmod(F.xxhash64("id", "n_chars"), F.lit(salts)).cast("int").alias("salt"), order.cast("decimal(38,0)").alias("rank"))
        .groupBy("digest", "salt", "content")
        .agg(F.max_by("id", "rank").alias("keep_id"), F.max("n_chars").alias("keep_chars"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    )
    whole = salted.groupBy("digest", "content").agg(
        F.max_by("keep_id", "rank").alias("keep_id"), F.max("keep_chars").alias("keep_chars"), F.sum("n").alias("group_size")
    )
    groups = freeze(whole.drop("content"), "groups")
    if _any(groups.groupBy("digest").count()):  # different contents under one digest: match by content
        key = ["digest", "content"]
        groups, members = whole, rows.select("*", tag)
    else:
        key = ["digest"]
        groups = small(groups)
    found = members.join(groups, key, "left")
    alone = F.col("group_size").isNull()
    found = found.withColumns({"keep_id": F.when(alone, F.col("id")).otherwise(F.col("keep_id")), "keep_chars": F.when(alone, F.col("n_chars")).otherwise(F.col("keep_chars")), "group_size": F.coalesce("group_size", F.lit(1))})
    if not _any(members.groupBy("id").count()):
        out = found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    else:  # repeated ids: of a winner's repeats the one with the smallest tag stays
        out = freeze(found, "found")
        best = out.where(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
        best = best.groupBy(*key).agg(F.min("tag").alias("tag")).select("tag", F.lit(True).alias("kept"))
        out = out.join(best, "tag", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest", "n_chars")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    own, digest, chars = fresh(docs, "__id", "__digest", "__chars")
    found = freeze(copies(docs, id_col, text_col, salts).select(F.col(id_col).alias(own), F.col("digest").alias(digest), F.col("n_chars").alias(chars), "kept"), "kept")
    same = docs[id_col].eqNullSafe(F.col(own))
    repeated = freeze(found.groupBy(own).count().where("count > 1").select(own), "repeated")
    if repeated.isEmpty():
        return docs.join(small(freeze(found.where("not kept").select(own), "gone")), same, "left_anti")
    found = found.where("kept").drop("kept")
    exact = same & (sha256(without_blanks(docs[text_col])) == F.col(digest)) & (F.length(F.coalesce(docs[text_col], F.lit(""))) == F.col(chars))
    of = repeated.withColumnRenamed(own, "again")
    alone = found.join(of, F.col(own).eqNullSafe(F.col("again")), "left_anti")
    twice = found.join(of, F.col(own).eqNullSafe(F.col("again")), "left_semi")
    first = [F.first(docs[c]).alias(c) for c in docs.columns]
    of_twice = docs.join(twice, exact).groupBy(own, digest, chars).agg(*first).select(*docs.columns)
    return docs.join(alone, same, "left_semi").unionByName(of_twice)


def _any(counts: DataFrame) -> bool:
    return not counts.where("count > 1").isEmpty()
