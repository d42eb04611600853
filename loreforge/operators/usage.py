"""Conversations and usage events."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def threads(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: one value a conversation, whatever its length. Turns of null role or text count, and have no line."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda p: F.concat(p["role"], F.lit(": "), p["text"])
    return conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(parts, line), "\n").alias("text"))


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: user turns and the assistant turns right after them, in order of turn (nulls first), role and text. A conversation
    of more than ``ranges.LARGE`` turns is gone through in ranges."""
    rows, order = conversations.select("conv_id", "turn", "role", "text"), {"turn": True, "role": True, "text": True}
    if ranges.has_large(rows, "conv_id"):  # in falling order the next turn comes before
        rows = ranges.with_rows_before(rows, "conv_id", dict.fromkeys(order, False), 1)
        own = Window.partitionBy("part", "conv_id").orderBy(*order)
    else:
        rows = rows.withColumn("borrowed", F.lit(False))
        own = Window.partitionBy("conv_id").orderBy(*order)
    rows = rows.select("conv_id", "turn", "role", "borrowed", F.col("text").alias("question"), F.lead("role").over(own).alias("next"), F.lead("text").over(own).alias("answer"))
    return rows.where("role = 'user' and next = 'assistant' and not borrowed").select("conv_id", "turn", "question", "answer")


def _usage(events: DataFrame, window) -> DataFrame:
    rows = events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def usage_tumbling(events: DataFrame, w: str = "1 hour") -> DataFrame:
    return _usage(events, F.window("ts", w))


def usage_sliding(events: DataFrame, w: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return _usage(events, F.window("ts", w, step))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, last, n. An event that comes just gap after the last one belongs to its session."""
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return rows.select("user_id", F.col("s.start").alias("start"), "last", "n")


def running_usage(events: DataFrame, n: int = 7) -> DataFrame:
    """event_id, user_id, running (the sum of the last n values in order of ts and event_id), rank (of the value, the largest first). A user of more
    than ``ranges.LARGE`` events is gone through in ranges, and ranked by counts of values."""
    rows = events.select("event_id", "user_id", "ts", "value")
    if not ranges.has_large(rows, "user_id"):
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return rows.select("event_id", "user_id", F.round(F.sum("value").over(order.rowsBetween(-n + 1, 0)), 4).alias("running"), F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"))).cast("bigint").alias("rank"))
    order = Window.partitionBy("part", "user_id").orderBy("ts", "event_id").rowsBetween(-n + 1, 0)
    dealt = ranges.with_rows_before(rows, "user_id", {"ts": True, "event_id": True, "value": True}, n - 1)
    found = dealt.withColumn("running", F.round(F.sum("value").over(order), 4)).where("not borrowed")
    counts = rows.groupBy("user_id", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = ranges.greater_before(counts, "user_id", F.desc("value"), "n").select(F.col("user_id").alias("own"), F.col("value").alias("of"), (F.col("before") + 1).alias("rank"))
    same = found["user_id"].eqNullSafe(ranks["own"]) & found["value"].eqNullSafe(ranks["of"])
    return found.join(ranks, same).select("event_id", "user_id", "running", F.col("rank").cast("bigint").alias("rank"))


def funnel(events: DataFrame) -> DataFrame:
    """One row: users, those who viewed, and those whose last purchase follows their first view."""
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    users = events.groupBy("user_id").agg(F.min(at("view")).alias("viewed"), F.max(at("purchase")).alias("bought"))
    return users.agg(F.count(F.lit(1)).alias("users"), F.count("viewed").alias("viewed"), F.count_if(F.col("bought") > F.col("viewed")).alias("bought_after"))


def usage_by_prop(events: DataFrame, path: str = "$.k") -> DataFrame:
    return events.groupBy(F.get_json_object("props", path).alias("prop")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def active_users_approx(events: DataFrame, w: str = "1 day", rsd: float = 0.02) -> DataFrame:
    return events.groupBy(F.window("ts", w).alias("w")).agg(F.approx_count_distinct("user_id", rsd).alias("users")).select(F.col("w.start").alias("day"), "users")
