"""Keys of any size: what the dealt ways give is what plain windows give, and a hot key is in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from loreforge.functions import user
from loreforge.operators import ranges, usage
from loreforge.sources.tables import SCHEMAS, load


@pytest.fixture
def dealt(spark, monkeypatch):
    """Small ranges; every key counts as large."""
    plain = ranges.LARGE
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda small: monkeypatch.setattr(ranges, "LARGE", 0 if small else plain)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def both(dealt, run):
    dealt(False)
    want = sorted(map(repr, run().collect()))
    dealt(True)
    return sorted(map(repr, run().collect())), want


def test_running_usage(spark, dealt):
    rng = random.Random(4)
    some = load(spark, "/root/testdata/sf0.001", "events")
    hot = some.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(7)).when(F.col("event_id") % 31 == 0, F.lit(None)).otherwise(F.col("user_id")))
    hot = hot.withColumn("value", F.when(F.col("event_id") % 5 == 0, 1.0).when(F.col("event_id") % 97 == 0, F.lit(None)).otherwise(F.col("value"))).cache()
    got, want = both(dealt, lambda: usage.running_usage(hot))
    assert got == want and len(got) == some.count()
    parts = ranges.with_rows_before(hot.select("event_id", "user_id", "ts", "value"), "user_id", {"ts": True, "event_id": True}, 6).where("user_id = 7 and not borrowed").groupBy("part").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 300  # half of all events, over several tasks
    few = spark.createDataFrame([(i, None, 1, "click", float(rng.randrange(3)), None) for i in range(5)], SCHEMAS["events"])
    got, want = both(dealt, lambda: usage.running_usage(few.withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))))
    assert got == want


def test_question_and_answer_pairs(spark, dealt):
    rows = [(1, t, ["user", "assistant"][t % 2], f"t{t}") for t in range(300)] + [(2, None, "assistant", "x"), (2, 0, "user", None), (2, 1, "assistant", "a"), (3, 0, "user", "q"), (None, 0, "user", "q"), (None, 1, "assistant", "b"), (4, 0, "user", "u"), (4, 0, "assistant", "v")]
    df = spark.createDataFrame(rows, SCHEMAS["conversations"])
    got, want = both(dealt, lambda: usage.qa_pairs(df))
    assert got == want and len(got) == 152


def test_an_aggregate_of_a_hot_group(spark):
    """A group of half the table: each state is of one task's rows, and none of all."""
    df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 50).cast("string")).alias("k"), F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))

    def update(state, values):
        return [state[0] + len(values), state[1] + values.sum(), max(state[2], len(values))]

    merge = lambda a, b: [a[0] + b[0], a[1] + b[1], max(a[2], b[2])]
    mean = user.two_step_agg(df, ["k", "g"], "v", lambda: [0, 0.0, 0], update, merge, lambda s: s[1] / s[0], "mean", "double", fan=3)
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.avg("v").alias("m")).collect()}
    assert {r["k"]: r["mean"] for r in mean.collect()} == pytest.approx(want)
    seen = user.two_step_agg(df, ["k"], "v", lambda: [0, 0.0, 0], update, merge, lambda s: s[2], "most", "long")
    assert seen.where("k = 'hot'").first()["most"] <= 20_000 / 8
    assert user.two_step_agg(df.limit(0), ["k"], "v", list, update, merge, len, "n", "long").count() == 0


def test_many_small_groups_in_order(spark, monkeypatch):
    """A task merges the states of many groups in few batches, and updates a group once for many frames."""
    monkeypatch.setattr(user, "MERGED", 7)
    monkeypatch.setattr(user, "GROUPS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    df = spark.range(0, 4000, 1, 2).select((F.col("id") % 300).alias("k"), F.col("id").cast("double").alias("v"))
    add = lambda s, values: [s[0] + values.sum(), s[1] + 1]
    merge = lambda a, b: [a[0] + b[0], a[1] + b[1]]
    out = user.two_step_agg(df, ["k"], "v", lambda: [0.0, 0], add, merge, lambda s: s[0], "total", "double")
    assert {r["k"]: r["total"] for r in out.collect()} == {k: float(sum(range(k, 4000, 300))) for k in range(300)}
    calls = user.two_step_agg(df, ["k"], "v", lambda: [0.0, 0], add, merge, lambda s: s[1], "calls", "long").agg(F.max("calls")).first()[0]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert calls == 2  # one for each task, of twenty frames
