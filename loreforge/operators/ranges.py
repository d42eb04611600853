"""Windows over keys of any size: rows are dealt by ranges of key and order, so that a hot key's rows lie in many tasks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep

#: Rows of a key up to which a plain window takes it; if any key has more, all are dealt by ranges.
LARGE = 1 << 20


def has_large(rows: DataFrame, *keys: str) -> bool:
    return not rows.groupBy(*keys).count().where(F.col("count") > LARGE).limit(1).isEmpty()


def _sorted(order: dict[str, bool], turned: bool = False) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up != turned else F.col(c).desc_nulls_last() for c, up in order.items()]


def with_rows_before(rows: DataFrame, key: str, order: dict[str, bool], n: int) -> DataFrame:
    """rows in parts, with the columns part and borrowed: each part also has, borrowed, the n rows of its first key that come before its own (fewer if there
    are no more). So a window by part and key sees all that a frame of n rows reaches, and a part is a bounded range of rows. order (column: whether
    it rises; nulls are least) must tell all rows of a key apart, or rows that it doesn't tell apart must be equal."""
    dealt = keep(rows.repartitionByRange(F.col(key), *_sorted(order)).withColumn("part", F.spark_partition_id()), "dealt")
    in_part = Window.partitionBy("part", key)
    last = F.row_number().over(in_part.orderBy(*_sorted(order, turned=True)))
    ends = keep(dealt.withColumn("left", last).where(F.col("left") <= n), "ends")  # n rows of each part and key at most
    several = ends.groupBy(key).agg(F.count_distinct("part").alias("parts")).where("parts > 1").select(F.col(key).alias("own"))
    ends = ends.join(several, ends[key].eqNullSafe(several["own"])).drop("own")
    whole = F.struct(*[F.col(c) for c in rows.columns])
    before = F.collect_list(whole).over(Window.partitionBy(key).orderBy("part", *_sorted(order)).rowsBetween(-n, -1))
    first = F.row_number().over(in_part.orderBy(*_sorted(order)))
    borrowed = ends.withColumn("before", before).withColumn("first", first).where("first = 1").select("part", F.explode("before").alias("row"))
    borrowed = borrowed.select(*[F.col(f"row.{c}").alias(c) for c in rows.columns], "part", F.lit(True).alias("borrowed"))
    return dealt.withColumn("borrowed", F.lit(False)).unionByName(borrowed)


def greater_before(counts: DataFrame, key: str, order: Column, n: str) -> DataFrame:
    """counts (key, a column to order by, n) with ``before``: the sum of n over the key's rows that come before. One row for each key and value."""
    dealt = keep(counts.repartitionByRange(F.col(key), order).withColumn("part", F.spark_partition_id()), "dealt")
    so_far = Window.partitionBy("part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part", key).agg(F.sum(n).alias("all"))
    earlier = sums.withColumn("earlier", F.coalesce(F.sum("all").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = earlier.select(F.col("part").alias("own_part"), F.col(key).alias("own"), "earlier")
    rows = dealt.withColumn("before", F.coalesce(F.sum(n).over(so_far), F.lit(0)))
    joined = rows.join(earlier, (rows["part"] == earlier["own_part"]) & rows[key].eqNullSafe(earlier["own"]))
    return joined.withColumn("before", F.col("before") + F.col("earlier")).select(*counts.columns, "before")
