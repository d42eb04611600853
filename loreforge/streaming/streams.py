"""Streaming forms. Event times are cast to timestamp, which watermarks need; sessions are in UTC.

:func:`drain` runs a stream over all that is there and returns what it wrote.
"""

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.index import counts
from ..sources.tables import shared


def timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_usage(stream: DataFrame, w: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = timed(stream, late).groupBy(F.window("ts", w).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = timed(stream, late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("s.start").alias("start"), "n")


#: Groups into which keys are dealt by their hash: a group's Python state holds all of its keys, so its calls are made per group and not per key.
GROUPS = 256


def _stateful(stream: DataFrame, processor: StatefulProcessor, returns: str, late: str) -> DataFrame:
    """Runs processor on event time over the stream's rows with ``us``, the microseconds of ts, in ``GROUPS`` groups of whole keys."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    rows = timed(stream, late).where("ts is not null").withColumn("us", F.unix_micros("ts")).withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    return rows.groupBy("group").transformWithStateInPandas(processor, returns, "append", "eventTime")


def _keyed(stream: DataFrame, keys) -> DataFrame:
    """stream with ``key``, the keys in one string: nulls are a key, too."""
    return stream.withColumn("key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))


def _wake(handle, ms: int | None) -> None:
    """Leaves the group one timer, at ms, or none."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    if ms is not None:
        handle.registerTimer(ms)


def _micros(span: str) -> int:
    return round(pd.Timedelta(span).total_seconds() * 1e6)


def _load(state, columns: list[str]) -> pd.DataFrame:
    """A table that :func:`_store` has put into a value state: one value a group, so a group's rows cost one call."""
    return pa.ipc.open_stream(state.get()[0]).read_pandas() if state.exists() else pd.DataFrame({c: pd.Series(dtype=object if c == "key" else "int64") for c in columns})


def _store(state, rows: pd.DataFrame) -> None:
    if not len(rows):
        return state.clear()
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


class _Earliest(StatefulProcessor):
    """Keeps events of its keys until the watermark has passed them, then lets each key's survivors out in order of time."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.last = handle.getValueState("last", "rows binary")

    def _wait(self, rows: pd.DataFrame) -> None:
        """Holds rows; wakes up when the watermark has passed the first one."""
        _store(self.waiting, rows)
        _wake(self.handle, int(rows["us"].min()) // 1000 + 1 if len(rows) else None)

    def handleInputRows(self, key, rows, timerValues):
        new = [f[["key", "us", "event_id"]] for f in rows]
        self._wait(pd.concat([_load(self.waiting, ["key", "us", "event_id"]), *new], ignore_index=True))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, held, last = timerValues.getCurrentWatermarkInMs(), _load(self.waiting, ["key", "us", "event_id"]), _load(self.last, ["key", "us"])
        due = held["us"] // 1000 < passed
        now = held[due].sort_values(["key", "us", "event_id"], ignore_index=True)
        until, stays = {k: us + self.span for k, us in zip(last["key"], last["us"].tolist(), strict=True)}, []
        for k, us in zip(now["key"], now["us"].tolist(), strict=True):
            stay = k not in until or us > until[k]
            if stay:
                until[k] = us + self.span
            stays.append(stay)
        near = [(k, us - self.span) for k, us in until.items() if us // 1000 >= passed]  # whatever comes now is later than the others reach
        _store(self.last, pd.DataFrame(near, columns=["key", "us"]))
        self._wait(held[~due])
        if any(stays):
            yield now.loc[stays, ["key", "event_id", "us"]]

    def close(self) -> None:
        pass


def stream_dedup(stream: DataFrame, keys=("user_id", "event_type"), late: str = "1 hour") -> DataFrame:
    """event_id, *keys, ts. Of the events of each key the earliest one survives (of equal times the smallest event_id) and drops those up to ``late`` after
    it; the first one later than that survives next, and so on. An event is decided when the watermark has passed it, so the survivors don't
    depend on how the stream is cut into batches; until then they are the state of the key's group."""
    kinds = ", ".join(f"{k} {dict(stream.dtypes)[k]}" for k in keys)
    out = _stateful(_keyed(stream, keys), _Earliest(_micros(late)), "key string, event_id long, us long", late)
    return out.withColumn("k", F.from_json("key", kinds)).select("event_id", *[F.col(f"k.{k}").alias(k) for k in keys], F.timestamp_micros("us").alias("ts"))


def stream_view_purchase(stream: DataFrame, span: str = "6 hours", late: str = "1 hour") -> DataFrame:
    rows = timed(stream, late)
    view = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed"))
    buy = rows.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    return view.join(buy, F.expr(f"user_id = buyer and bought > viewed and bought <= viewed + interval {span}")).select("user_id", "view_id", "purchase_id")


class _Spells(StatefulProcessor):
    """Keeps its users' spells of use, and lets one go when its user has been silent for ``quiet``."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.spells = handle.getValueState("spells", "rows binary")

    def _hold(self, spells: pd.DataFrame) -> None:
        _store(self.spells, spells)
        _wake(self.handle, (int(spells["last"].min()) + self.quiet) // 1000 + 1 if len(spells) else None)

    def handleInputRows(self, key, rows, timerValues):
        new = [pd.DataFrame({"key": f["key"], "first": f["us"], "last": f["us"], "n": 1, "value": f["value"].astype(float).fillna(0.0)}) for f in rows]
        held = [_load(self.spells, [])] if self.spells.exists() else []
        all_ = pd.concat([*held, *new], ignore_index=True).sort_values(["key", "first", "last", "n", "value"], ignore_index=True)
        reach = all_.groupby("key")["last"].cummax().shift() + self.quiet
        begins = (all_["key"] != all_["key"].shift()) | (all_["first"] > reach)
        self._hold(all_.groupby(begins.cumsum(), as_index=False).agg({"key": "first", "first": "min", "last": "max", "n": "sum", "value": "sum"}))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = _load(self.spells, ["key", "first", "last", "n", "value"])
        done = (held["last"] + self.quiet) // 1000 < timerValues.getCurrentWatermarkInMs()
        self._hold(held[~done])
        if done.any():
            yield held[done].round({"value": 4})

    def close(self) -> None:
        pass


def stream_user_state(stream: DataFrame, quiet: str = "1 day", late: str = "1 hour") -> DataFrame:
    """user_id, first, last, n, value: the totals of each spell of a user's events with no pause of more than ``quiet``. It comes out, and its state goes, when
    the watermark has passed the end of that pause. Null values count as none."""
    out = _stateful(_keyed(stream, ["user_id"]), _Spells(_micros(quiet)), "key string, first long, last long, n long, value double", late)
    user = F.from_json("key", "user_id long")["user_id"].alias("user_id")
    return out.select(user, F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", "value")


def replay(rows: DataFrame, order: str = "ts", files: int = 4) -> DataFrame:
    """rows as a stream that brings them in that order: files of equal size, the names and times of which go by the ranges they hold, one in each batch."""
    spark, path = rows.sparkSession, shared(rows.sparkSession, "replay")
    rows.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath().toString(), f.getPath()) for f in fs.listStatus(hadoop) if f.getPath().getName().startswith("part-"))
    for k, (_, at) in enumerate(parts):  # a file a batch
        fs.setTimes(at, 1_000_000_000_000 + 1000 * k, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(path)


def drain(out: DataFrame, mode: str = "append") -> DataFrame:
    """Every row that the stream writes, kept in the shared folder."""
    spark, path = out.sparkSession, shared(out.sparkSession, "stream")
    write = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/rows/b{k}")  # noqa: E731  a batch that runs again overwrites its own rows
    write(spark.createDataFrame([], out.schema), -1)  # so that a stream of nothing has no rows
    out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


#: Segments of one tier that are merged into one of the next.
FAN = 4


def stream_index(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Postings kept up with a stream of documents: new ones replace old postings of their doc_id.

    Each batch writes its own postings and ids as a segment, so its cost is that of its own documents. ``FAN`` segments of one tier are merged
    into one of the next, without the postings that later batches replaced, so there are few segments however many batches came. A version file
    names the segments in use once they are all written: readers take the last version, and segments go when neither it nor the one before names them. All that is
    known lies in path, so a stream that starts again with the same path goes on where it ended, and a batch that runs again starts from the
    version before it. A document that occurs twice in one batch has the postings of all its texts there; documents without a doc_id are left out.
    """
    spark, path = stream.sparkSession, path or shared(stream.sparkSession, "index")

    def update(batch, k):
        rows = batch.where("doc_id is not null")
        at = f"b{k}"
        counts(rows).withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{path}/segments/{at}/postings")
        rows.select("doc_id", F.lit(k).cast("long").alias("batch")).distinct().write.mode("overwrite").parquet(f"{path}/segments/{at}/ids")
        before = _version(spark, path, k)
        live, tier = [*before, (at, 0)], 0
        while len(group := [s for s in live if s[1] == tier]) >= FAN:
            merged = (f"m{k}-{tier + 1}", tier + 1)
            _merge(spark, path, [s for s, _ in group], merged[0])
            live = [s for s in live if s[1] > tier] + [merged] + [s for s in live if s[1] < tier]
            tier += 1
        spark.createDataFrame([(n, *s) for n, s in enumerate(live)], "place int, segment string, tier int").coalesce(1).write.mode("overwrite").json(f"{path}/versions/{k}")
        _sweep(spark, path, {s for s, _ in [*before, *live]})

    if not _names(spark, f"{path}/versions"):
        update(spark.createDataFrame([], stream.schema), -1)  # so that a stream without documents has an index, too
    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(update).start().awaitTermination()
    return read_stream_index(spark, path)


def _folder(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _version(spark, path: str, before: int | None = None) -> list[tuple[str, int]]:
    """The segments of the last committed version, or of the last one before a batch."""
    fs, _ = _folder(spark, path)
    done = [int(n) for n in _names(spark, f"{path}/versions") if fs.exists(_folder(spark, f"{path}/versions/{n}/_SUCCESS")[1])]
    done = [n for n in done if before is None or n < before]
    if not done:
        return []
    rows = spark.read.schema("place int, segment string, tier int").json(f"{path}/versions/{max(done)}").collect()  # a row per segment
    return [(r["segment"], r["tier"]) for r in sorted(rows)]


def _live(spark, path: str, segments: list[str]) -> tuple[DataFrame, DataFrame]:
    """postings and ids of segments, without what later batches among them replaced."""
    read = lambda what, schema: spark.read.schema(schema).parquet(*[f"{path}/segments/{s}/{what}" for s in segments])
    ids = read("ids", "doc_id long, batch long").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return read("postings", "term string, doc_id long, tf long, batch long").join(ids, ["doc_id", "batch"], "left_semi"), ids


def _merge(spark, path: str, segments: list[str], into: str) -> None:
    postings, ids = _live(spark, path, segments)
    postings.select("term", "doc_id", "tf", "batch").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/segments/{into}/postings")
    ids.write.mode("overwrite").parquet(f"{path}/segments/{into}/ids")


def _sweep(spark, path: str, used: set) -> None:
    for name in _names(spark, f"{path}/segments"):
        if name not in used:
            fs, at = _folder(spark, f"{path}/segments/{name}")
            fs.delete(at, True)


def read_stream_index(spark, path: str) -> DataFrame:
    """term, doc_id, tf."""
    return _live(spark, path, [s for s, _ in _version(spark, path)])[0].select("term", "doc_id", "tf")
