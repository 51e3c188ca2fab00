"""Streams in several batches, out of order and late, against what their rows say as a whole."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trackloom.streaming import operators as S
from trackloom.streaming import processors as P
from trackloom.streaming.replay import start

DAY = datetime.datetime(2024, 1, 1)
LAST = (10**6,)


def at(seconds):
    return DAY + datetime.timedelta(seconds=seconds)


def streamed(spark, folder, batches, schema):
    """One file, and so one micro-batch, for each list of rows."""
    for k, some in enumerate(batches):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(stream, folder):
    """All rows, and how many rows of state are left."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query = start(lambda: writer.start(f"{folder}/rows"), stream.sparkSession)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows").collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def dealt(rows, batches, delay, seed):
    """``rows``, whose second field is a time, in batches, each up to ``delay`` seconds later than it should be."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(0, delay)))
    size = -(-len(late) // batches)
    return [rng.sample(late[k : k + size], len(late[k : k + size])) for k in range(0, len(late), size)]


def test_gaps_and_laps_close_without_an_end(spark, tmp_path):
    schema = "run long, at timestamp, arc double"
    seconds = {1: [0, 1, 2, 5, 6, 9], 2: [3, 4], 3: [0, 1, 100, 101, 104]}
    rows = [(run_, at(t), t * 2.5) for run_, ts in seconds.items() for t in ts]
    batches = [*dealt(rows, 3, 4, 1), [(-1, at(10_000), 0.0)], [(-1, at(90_000), 0.0)]]
    got, left = run(P.gaps(streamed(spark, str(tmp_path / "g"), batches, schema), "run", "at", 20_000, 1000, "10 seconds"), str(tmp_path / "go"))
    base = int(DAY.replace(tzinfo=datetime.timezone.utc).timestamp())
    told = sorted((r.run, r.from_s - base, r.to_s - base) for r in got if r.run > 0)
    assert told == [(1, 3, 4), (1, 7, 8), (1, 10, 29), (2, 5, 24), (3, 2, 21), (3, 102, 103), (3, 105, 124)]
    got, left = run(P.laps(streamed(spark, str(tmp_path / "l"), batches, schema), "run", "arc", "at", 10.0, 20_000, "10 seconds"), str(tmp_path / "lo"))
    assert sorted((r.run, r.lap, r.seconds) for r in got if r.run > 0) == [(1, 0, 5.0), (1, 1, 4.0), (1, 2, 0.0), (2, 0, 1.0), (2, 1, 0.0), (3, 0, 1.0), (3, 25, 4.0), (3, 26, 0.0)]
    # what is left is the row that moved the watermark last, and its timer: one waits, one tells when it is due
    assert left <= 4


@pytest.mark.parametrize("seed", [1, 2])
def test_entries_in_event_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    regions = [(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), (2, [(5.0, 5.0), (30.0, 5.0), (5.0, 30.0)]), (3, [(1.0, 1.0), (2.0, 2.0)])]
    inside = {1: lambda x, y: 0 <= x < 10 and 0 <= y < 10, 2: lambda x, y: x > 5 and y > 5 and x + y < 35}
    rows, want = [], set()
    for run_ in (1, 2, 3):
        here, counts = set(), {}
        for k in range(60):
            x, y = rng.uniform(-5, 25) + 0.001, rng.uniform(-5, 25) + 0.001
            rows.append((run_, at(k // 2), 1000 * run_ + k, x, y))
            now = {r for r, f in inside.items() if f(x, y)}
            for r in now - here:
                want.add((run_, r, 1000 * run_ + k, counts.get(r, 0)))
                counts[r] = counts.get(r, 0) + 1
            here = now
    schema = "run long, at timestamp, k long, x double, y double"
    stream = streamed(spark, str(tmp_path / "in"), [*dealt(rows, 4, 8, seed), [(-1, at(10_000), 0, 0.0, 0.0)]], schema)
    shapes = spark.createDataFrame(regions, "region_id long, ring array<struct<x: double, y: double>>")
    got, _ = run(P.entries(stream, shapes, "run", "at", "k", 3_600_000, size=8.0, watermark="10 seconds"), str(tmp_path / "out"))
    assert len(got) == len(want) and {(r.run, r.region_id, r.k, r.entry) for r in got} == want


EVENTS = "task_id long, at timestamp, event_id long, type string, watcher long"


@pytest.mark.parametrize("seed", [3, 4])
def test_watchers_join_at_any_event(spark, tmp_path, seed):
    rng = random.Random(seed)
    events, joins = [], []
    for task in (1, 2, 3):
        end = rng.randrange(10, 30)
        events += [(task, at(k // 2 * 2), 100 * task + k, "done" if k == end else rng.choice(["state", "log"]), None) for k in range(34)]
        joins += [(task, at(k), None, None, 50 * task + k) for k in range(0, 40, 3)]
    stream = streamed(spark, str(tmp_path / "in"), [*dealt(events + joins, 5, 6, seed), [(-1, at(10_000), 0, "log", None)]], EVENTS)
    got, _ = run(P.watched(stream.where("watcher is null"), stream.where("watcher is not null"), watermark="10 seconds"), str(tmp_path / "out"))
    told = {}
    for r in got:
        if r.task_id > 0:
            told.setdefault((r.task_id, r.watcher), []).append((r.kind, r.event_id, r.type))
    for task, since, _, _, watcher in joins:
        own = sorted((t, i, kind) for k, t, i, kind, _ in events if k == task)
        stop = next(n for n, e in enumerate(own) if e[2] == "done")
        before = [e for e in own[: stop + 1] if e[0] <= since]
        want = [("snapshot", *(before[-1][1:] if before else (None, None)))] + [("event", *e[1:]) for e in own[: stop + 1] if e[0] > since]
        assert sorted(told[task, watcher], key=repr) == sorted(want, key=repr)


def test_a_lagging_watcher_gets_the_state_instead(spark, tmp_path):
    join = [(task, at(0), None, None, 9) for task in (1, 2)]
    first = [(1, at(1), 1, "log", None), *join]
    many = [(1, at(100 + k), 10 + k, "log", None) for k in range(8)] + [(2, at(100), 30, "log", None), (2, at(101), 31, "done", None), (2, at(102), 32, "log", None)]
    stream = streamed(spark, str(tmp_path / "in"), [first, [(-1, at(60), 0, "log", None)], many, [(-1, at(10_000), 0, "log", None)]], EVENTS)
    got, _ = run(P.watched(stream.where("watcher is null"), stream.where("watcher is not null"), lag=4, watermark="10 seconds"), str(tmp_path / "out"))
    assert sorted((r.task_id, r.kind, r.event_id or 0) for r in got if r.task_id > 0) == [(1, "event", 1), (1, "snapshot", 0), (1, "snapshot", 17), (2, "event", 30), (2, "event", 31), (2, "snapshot", 0)]


def test_late_rows_count_once_whatever_fails(spark, tmp_path):
    schema = "run long, at timestamp, speed double"
    rng = random.Random(5)
    rows = [(1, at(60 * k), rng.uniform(0, 9)) for k in range(200)]
    late = rows[::7]
    batches = [[r for r in rows if r not in late], late[:9], late[9:], [(1, at(60 * 300), 1.0)]]
    folder = str(tmp_path)
    stream = streamed(spark, f"{folder}/in", batches, schema)
    sink = S.RepairedWindows(spark, f"{folder}/out", "at", "30 minutes")
    broken = {1, 2}

    def failing(some, batch):
        sink(some, batch)
        if batch in broken:
            broken.remove(batch)
            raise RuntimeError("lost after it was written")

    for _ in range(3):  # a restart after each failure runs the same batch again
        query = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(failing).start()
        try:
            query.awaitTermination()
        except Exception as lost:
            assert "lost after it was written" in str(lost)
    whole = spark.createDataFrame([r for some in batches for r in some], schema)
    want = sorted((r.start, r.n, round(r["mean"], 9), r.top) for r in S.speed_windows(whole, "at", "30 minutes").collect())
    got = sink.windows().collect()
    assert sorted((r.start, r.n, round(r["mean"], 9), r.top) for r in got) == want
    caught = sink.late(schema).collect()
    passed = max(r[1] for r in batches[0]) - datetime.timedelta(minutes=10)
    dropped = [r for r in late if datetime.datetime(2024, 1, 1, r[1].hour, r[1].minute // 30 * 30) + datetime.timedelta(minutes=30) <= passed]
    assert sorted(r.at for r in caught) == sorted(r[1] for r in dropped) and dropped
    assert {r.start for r in got if r.repaired} == {r[1].replace(minute=r[1].minute // 30 * 30) for r in dropped}
