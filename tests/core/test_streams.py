"""Streams of several files in order, with rows that come late and rows that come too late, against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreforge.sources.tables import SCHEMAS
from loreforge.streaming import streams

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def made(seed=1, n=400):
    """Events of four days, in order of time."""
    rng = random.Random(seed)
    ts = sorted(START + timedelta(seconds=rng.randrange(4 * 86_400)) for _ in range(n))
    return [(i, t, rng.randrange(6), rng.choice(["view", "purchase", "click"]), float(rng.randrange(90)), None) for i, t in enumerate(ts)]


def batches(rows, files=4, seed=2):
    """The rows in files of a day each; some rows come up to 50 minutes late, in the next file. And rows that no file should count: the last one's, of the first day."""
    rng, out = random.Random(seed), [[] for _ in range(files)]
    for r in rows:
        day = (r[1] - START).days
        end = START + timedelta(days=day + 1)
        late = day + 1 < files and end - r[1] < timedelta(minutes=50) and rng.random() < 0.5
        out[day + late].append(r)
    too_late = [(10_000 + i, START + timedelta(minutes=7 * i), i % 6, ["view", "purchase"][i % 2], 1e6, None) for i in range(12)]
    out[-1] += too_late
    return out


def stream(spark, path, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMAS["events"].replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture
def late(spark, rows, tmp_path):
    return stream(spark, f"file://{tmp_path}/events", batches(rows))


def passed(rows):
    return max(r[1] for r in rows) - HOUR


def test_windows(rows, late):
    got = Counter({(r["start"], r["event_type"]): r["n"] for r in streams.drain(streams.stream_usage(late)).collect()})
    want = Counter((r[1].replace(minute=0, second=0), r[3]) for r in rows)
    assert got == Counter({k: n for k, n in want.items() if k[0] + HOUR <= passed(rows)}) and len(got) > 100


def spells(rows, pause):
    """user, first, last, n, value of runs of events with no longer pause."""
    out = []
    for user in {r[2] for r in rows}:
        run = []
        for r in sorted(r for r in rows if r[2] == user):
            if run and r[1] - run[-1][1] > pause:
                out.append(run)
                run = []
            run.append(r)
        out.append(run)
    return [(r[0][2], r[0][1], r[-1][1], len(r), sum(x[4] for x in r)) for r in out]


def test_sessions(rows, late):
    half = timedelta(minutes=30)
    got = {tuple(r) for r in streams.drain(streams.stream_sessions(late)).select("user_id", "start", "n").collect()}
    assert got == {(u, a, n) for u, a, b, n, _ in spells(rows, half) if b + half <= passed(rows)} and len(got) > 50


def survivors(rows, span=HOUR):
    last, out = {}, set()
    for i, ts, user, kind, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        if (user, kind) not in last or ts > last[user, kind] + span:
            last[user, kind] = ts
            out.add((i, user, kind, ts))
    return out


def test_survivors_whatever_the_batches(spark, rows, late, tmp_path):
    want = {r for r in survivors(rows) if r[3] < passed(rows)}
    assert 50 < len(want) < len(rows) - 10
    assert {tuple(r) for r in streams.drain(streams.stream_dedup(late)).collect()} == want
    cut = random.Random(9).sample(range(1, len(rows)), 3)
    parts = [rows[a:b] for a, b in zip([0, *sorted(cut)], [*sorted(cut), len(rows)], strict=True)]
    again = stream(spark, f"file://{tmp_path}/again", [random.Random(4).sample(p, len(p)) for p in parts])
    assert {tuple(r) for r in streams.drain(streams.stream_dedup(again)).collect()} == want


def test_views_and_purchases(rows, late):
    got = {tuple(r) for r in streams.drain(streams.stream_view_purchase(late)).collect()}
    want = {(v[2], v[0], p[0]) for v in rows for p in rows if v[2] == p[2] and v[3] == "view" and p[3] == "purchase" and timedelta(0) < p[1] - v[1] <= 6 * HOUR}
    assert want <= got and len(want) > 30
    assert not {r for r in got - want if r[1] >= 10_000 and r[2] < 10_000 or r[2] >= 10_000 and r[1] < 10_000}  # nothing of the first day is left to meet a row that comes then


def test_a_silent_users_state_goes(spark, tmp_path):
    rows = [r for r in made(5) if r[2] != 3 or r[1] < START + timedelta(days=1)] + [(900, START + timedelta(hours=2), 9, "view", None, None)]
    source = stream(spark, f"file://{tmp_path}/events", [[r for r in rows if (r[1] - START).days == d] for d in range(4)])
    out = streams.stream_user_state(source, quiet="6 hours")
    query = out.writeStream.outputMode("append").format("memory").queryName("spells").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("spells").collect()}
    quiet = timedelta(hours=6)
    every = spells([(*r[:4], r[4] or 0.0) for r in rows], quiet)
    assert got == {s for s in every if s[2] + quiet < passed(rows)} and {3, 9} <= {s[0] for s in got}
    left = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    open_ = [s for s in every if s[2] + quiet >= passed(rows)]
    assert not {3, 9} & {s[0] for s in open_} and len(open_) <= left <= 3 * len(open_)  # a spell and a timer each


def test_an_index_of_few_segments(spark, tmp_path):
    path, place = f"file://{tmp_path}/index", f"file://{tmp_path}/docs"
    rng, texts = random.Random(8), {}
    for k in range(20):
        docs = {rng.randrange(30): " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6))) for _ in range(5)}
        texts |= docs
        spark.createDataFrame([*docs.items(), (None, "lost")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(place)
    source = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(place)
    want = {(t, i, n) for i, text in texts.items() for t, n in Counter(text.split()).items()}
    assert {tuple(r) for r in streams.stream_index(source(), path).collect()} == want
    live = streams._version(spark, path)
    assert len(live) <= 6 and max(Counter(t for _, t in live).values()) < streams.FAN
    assert len(streams._names(spark, f"{path}/segments")) <= 12  # those of the version before are still there
    old = streams._version(spark, path, max(int(n) for n in streams._names(spark, f"{path}/versions")))
    assert streams._live(spark, path, [s for s, _ in old])[0].count() > 0  # a reader of the version before still reads
    spark.createDataFrame([(1, "new")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(place)
    again = {tuple(r) for r in streams.stream_index(source(), path).collect()}
    assert again == {r for r in want if r[1] != 1} | {("new", 1, 1)}


def test_calls_of_state_dont_grow_with_keys(spark, tmp_path):
    rows = [(i, START + timedelta(minutes=i % 300), i, "view", 1.0, None) for i in range(3000)]
    out = streams.stream_dedup(stream(spark, f"file://{tmp_path}/events", [rows]))
    query = out.writeStream.outputMode("append").format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.awaitTermination()
    assert {r["event_id"] for r in spark.table("firsts").collect()} == {r[0] for r in rows if r[1] < passed(rows)}
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4 * streams.GROUPS  # a value or two and a timer a group, not a key
