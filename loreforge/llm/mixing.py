"""Mixing sources to target weights by Pareto order sampling, with built-in expressions alone.

Sources in code point order, null last, weigh as ``weights`` repeats, and share ``share`` times the words
of the whole table. A target stops at ``most`` times its source's words; what is over is shared again by
weight until no target is above.

Within a source, a document's expected number of copies rises with the root of its size: it is
min(most, level * weight), weight = floor(16 * sqrt(size)), and the level is such that the expected words are the
source's target. The whole part of that number is taken for certain. The fractional parts are the inclusion
probabilities p of an unequal-probability sample by Pareto order sampling (Rosen 1997): document i ranks by
odds(u_i) / odds(p_i), where u_i is a uniform number made from its id, and the first ones are taken. The sample is of a
fixed size in words, what the whole copies leave of the target: documents are taken in rank order as long as the middle
of the next one is within it, so a source misses its target by at most half of one document.

No source is ever sorted whole: the level follows from one row per source and size; word counts over 4096 rank intervals
find the interval in which the sample ends, the same again within it, and only the documents of that last interval
are put in order. Sources are numbered and summed up in ranges of them, so that as many sources as documents would do, too.

Null texts have size 0. Rows that repeat an id share its random number, rank by size and are otherwise alike.
An empty table gives an empty result; a source without words has target 0 and gives nothing. Columns of any other name
pass through :func:`mixed` untouched.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, freeze, fresh, small

CELLS = 4096
#: Hexadecimal digits of a digest that make a uniform number, and their range.
DIGITS, RANGE = 13, float(16**13)


def uniform(id_col: str, seed: str):
    """From 0 to 1, both excluded."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(RANGE)


def running(df: DataFrame, order: list, **sums: str) -> DataFrame:
    """df with running sums ahead of each row in the given order, and the sums of all: <name> and <name>_all.

    Rows are dealt into ranges, which are summed up alone; only the ranges' totals meet in one task."""
    rows = freeze(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_of", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("range", F.shiftright("row_of", 33))
    inside = Window.partitionBy("range").orderBy("row_of").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ahead, all_ = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(F.col("range").alias("of"), *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_ahead") for n in sums], *[F.sum(n).over(all_).alias(f"{n}_all") for n in sums])
    out = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()]).join(totals, F.col("range") == F.col("of"))
    return out.withColumns({n: F.col(n) + F.col(f"{n}_ahead") for n in sums}).drop("range", "of", "row_of", *[f"{n}_ahead" for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source, source_size, target."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    placed = running(by_source, [F.col("source").asc_nulls_last()], place="one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    ranked = placed.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit"))
    ranked = running(ranked, [(F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], limits="limit", lighter="weight", words="source_size")
    # the level rises over the sources that reach their limit and falls after them
    level = (F.col("words_all") * F.lit(share) - F.col("limits")) / (F.col("lighter_all") - F.col("lighter"))
    ranked = freeze(ranked.withColumn("level", level).select("source", "source_size", "weight", "limit", "level"), "levels")
    highest = ranked.agg(F.max("level").alias("highest"))
    return ranked.join(F.broadcast(highest)).select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("highest") * F.col("weight")).alias("target"))


def expected(sizes: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """source, size, whole (certain copies), p (the inclusion probability of one more) and rest (words that the source samples)."""
    weight = F.floor(F.sqrt(F.greatest("size", F.lit(1)).cast("double")) * 16).cast("long")
    each = freeze(_of_source(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), goals).withColumn("weight", weight), "of_size")
    heavier = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("source")
    words = F.col("n") * F.col("size")
    # of all levels at which the heaviest ones take the most copies the highest is right, as min() is the lowest of its arguments
    left = F.sum(words * F.col("weight")).over(own) - F.coalesce(F.sum(words * F.col("weight")).over(heavier), F.lit(0))
    level = F.when(left > 0, (F.col("target") - most * F.coalesce(F.sum(words).over(heavier), F.lit(0))) / left)
    each = each.withColumn("level", level).withColumn("level", F.max("level").over(own))
    copies = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("level") * F.col("weight")))
    copies = F.when(F.col("source_size") > 0, F.coalesce(copies, F.lit(0.0))).otherwise(F.lit(0.0))
    each = each.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("long"))
    rest = F.col("target") - F.sum(F.col("whole") * words).over(own)
    return each.select("source", "size", "source_size", "target", "whole", (F.col("copies") - F.col("whole")).alias("p"), rest.alias("rest"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """One row per row of docs: <id_col>, source, size, source_size, target, p, copies, taken."""
    size = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long")
    sizes = freeze(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    goals = freeze(targets(sizes, weights, share, most), "goals")
    plan = freeze(expected(sizes, goals, most), "expected")

    u, p = uniform("id", seed), F.col("p")
    odds = F.when((p > 0) & (F.col("rest") > 0), (u / (1 - u)) / (p / (1 - p)))
    place = F.col("odds") / (1 + F.col("odds")) * CELLS
    of = small(plan.select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), "source_size", "target", "whole", "p", "rest"))
    ranked = sizes.join(of, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))).drop("of_source", "of_size")
    ranked = ranked.withColumn("odds", odds).withColumn("cell", F.floor(place)).withColumn("fine", F.floor((place - F.floor(place)) * CELLS))

    ends = freeze(_end(ranked, "cell", F.lit(0)), "ends")
    inside = _of_source(ranked, ends).where("cell = end_cell").withColumnRenamed("words_cell", "base")
    ends = freeze(_of_source(ends, _end(inside, "fine", F.col("base"))), "ends")
    ranked = ranked.join(small(ends.withColumnRenamed("source", "of_source")), F.col("source").eqNullSafe(F.col("of_source")), "left")
    sampled = F.col("odds").isNotNull()
    last = F.coalesce(sampled & (F.col("cell") == F.col("end_cell")) & (F.col("fine") == F.col("end_fine")), F.lit(False))
    order = Window.partitionBy("source").orderBy("odds", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("words_fine") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    picked = ranked.where(last).withColumn("extra", middle <= F.col("rest"))
    # a source whose sample never ends takes all that may be sampled
    before = F.col("end_cell").isNull() | (F.col("cell") < F.col("end_cell")) | ((F.col("cell") == F.col("end_cell")) & (F.col("fine") < F.col("end_fine")))
    sure = ranked.where(~last).withColumn("extra", F.coalesce(sampled & before, F.lit(False)))
    out = sure.unionByName(picked).withColumn("copies", F.col("whole") + F.col("extra").cast("long"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it was taken."""
    own, copies, rows, each, copy = fresh(docs, "__id", "__copies", "__rows", "__each", "__copy")
    counts = mix(docs, id_col=id_col, **options).groupBy(F.col(id_col).alias(own)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    counts = freeze(counts, "taken")
    found = docs.join(small(counts.where(F.col(copies) > 0)), docs[id_col].eqNullSafe(F.col(own)))
    n = F.col(copies)
    if not counts.where(F.col(rows) > 1).isEmpty():  # rows that repeat an id share its copies, which then differ by one at most
        place = F.row_number().over(Window.partitionBy(own).orderBy(*[docs[c] for c, kind in docs.dtypes if not kind.startswith("map")]))
        n = F.floor(n / F.col(rows)) + (place <= n % F.col(rows)).cast("long")
    found = found.withColumn(each, n).where(F.col(each) > 0)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(each).cast("int")))).select(*docs.columns)


def _of_source(left: DataFrame, by_source: DataFrame) -> DataFrame:
    by_source = by_source.withColumnRenamed("source", "of_source")
    return left.join(by_source, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def _end(ranked: DataFrame, cell: str, base) -> DataFrame:
    """For each source the cell in which its sample ends, and the words ahead of that cell."""
    cells = ranked.where("odds is not null").groupBy("source", cell).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(base).alias("base"))
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy(cell))
    cells = cells.withColumn("upto", upto).withColumn("ahead", F.col("upto") - F.col("words"))
    cells = cells.where((F.col("upto") > F.col("rest")) & (F.col("ahead") <= F.col("rest")))
    return cells.select("source", F.col(cell).alias(f"end_{cell}"), F.col("ahead").alias(f"words_{cell}"))
