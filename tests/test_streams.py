from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folium.sources.keyed_log import KeyedLog
from folium.streaming import events, kept, stateful

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 5, 1, tzinfo=timezone.utc)
ms = lambda t: int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1000)


def rows(n=240, seed=3):
    """Events of a few keys, one of which has half of them."""
    rng = random.Random(seed)
    at = sorted(rng.randrange(7_200_000) for _ in range(n))
    return [(i, START + timedelta(milliseconds=t), 0 if i % 2 else rng.randrange(1, 6), rng.choice(["error", "error", "ok"]), rng.choice([None, 1.0, 30.0, 400.0])) for i, t in enumerate(at)]


@pytest.fixture
def stream(spark, tmp_path):
    """The events in many files, out of order by up to half an hour, a file a micro-batch."""

    def made(data, files=8, per_trigger=1):
        rng = random.Random(9)
        line = sorted(data, key=lambda r: r[1] + timedelta(minutes=rng.randrange(30)))
        for i in range(files):
            part = line[i * len(line) // files : (i + 1) * len(line) // files]
            if part:
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(f"{tmp_path}/in")

    return made


def state_rows(spark, out):
    """What is left in the state of the query that wrote ``out``."""
    path = out.inputFiles()[0].rsplit("/out/", 1)[0]
    return spark.read.format("statestore").option("stateVarName", "state").load(f"{path}/state").count()


def test_failures_out_of_order(spark, stream):
    data = rows()
    got = stateful.run_to_end(stream(data), lambda s: stateful.failures(s, F.col("event_type") == "error"))
    want, n = set(), defaultdict(int)
    for i, t, k, kind, _ in data:
        n[k] = n[k] + 1 if kind == "error" else 0
        want.add((k, i, n[k], ms(t) + 86_400_000 if n[k] >= 3 else None))
    assert {tuple(r) for r in got.collect()} == want
    assert state_rows(spark, got) == sum(v > 0 for v in n.values())  # failing keys alone


def test_throttle_out_of_order(spark, stream):
    data = rows(seed=5)
    got = stateful.run_to_end(stream(data), lambda s: stateful.throttled(s, gap_ms=90_000, last=F.col("event_id") % 17 == 0))
    last, want = {}, set()
    for i, t, k, _, _ in data:
        if i % 17 == 0 or k not in last or ms(t) - last[k] >= 90_000:
            last[k] = ms(t)
            want.add((k, i, ms(t)))
    assert {tuple(r) for r in got.collect()} == want and state_rows(spark, got) == 0


def plain_pauses(notices, default=600_000):
    out, now = set(), {}
    for t, k, pause, answer in sorted(notices, key=lambda n: (n[0], n[0] + (default if n[2] is None else n[2]), n[3])):
        until = t + (default if pause is None else pause)
        if k in now and now[k][1] > t:
            now[k] = (now[k][0], max(now[k][1], until), now[k][2])
        else:
            out |= {(k, *now[k])} if k in now else set()
            now[k] = (t, until, answer)
    return out | {(k, *p) for k, p in now.items()}


def test_pauses_with_timers(spark, stream):
    data = rows(60, seed=7)
    build = lambda s: stateful.pauses(s, "user_id", (F.col("value") * 1000).cast("long"), F.col("event_type"))
    got = stateful.run_to_end(stream(data), build)
    want = plain_pauses([(ms(t), str(k), None if v is None else int(v * 1000), kind) for _, t, k, kind, v in data])
    assert {tuple(r) for r in got.collect()} == want
    path = got.inputFiles()[0].rsplit("/out/", 1)[0]
    left = spark.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", "true").load(f"{path}/state")
    assert left.count() == 0  # nothing is left after the last pause


def test_ring_goes_on_after_a_restart(spark, tmp_path):
    line = lambda i: (START + timedelta(seconds=i), ["ERROR", "WARN", "INFO", "DEBUG", "TRACE"][i % 5], f"line {i}")
    schema = "ts timestamp, level string, message string"

    def put(a, b):
        spark.createDataFrame([line(i) for i in range(a, b)], schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")

    def follow():
        ring = kept.LogRing(spark, f"file://{tmp_path}/ring", 10)  # as after a restart: nothing but the folder
        q = ring.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 9).parquet(f"{tmp_path}/in"), ["ts"]).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return ring

    assert kept.LogRing(spark, f"file://{tmp_path}/ring", 10).newest() is None
    put(0, 7)
    assert [(r.seq, r.message) for r in follow().newest().collect()] == [(i + 1, f"line {i}") for i in range(7)]
    put(7, 25)
    ring = follow()
    assert [r.seq for r in ring.newest().collect()] == list(range(16, 26))
    assert [(r.seq, r.message) for r in ring.newest(3).collect()] == [(i + 1, f"line {i}") for i in (22, 23, 24)]
    assert [r.seq for r in ring.published(18).collect()] == [i for i in range(19, 26) if (i - 1) % 5 < 3]
    before = ring.newest().collect()
    ring.add(spark.createDataFrame([line(99)], schema), ring.batches()[-1][0], ["ts"])  # a batch that runs again
    assert ring.newest().collect() == before
    ring.add(spark.createDataFrame([], schema), 77, ["ts"])
    ring.add(spark.createDataFrame([line(100)], schema), 78, ["ts"])
    assert [r.seq for r in ring.newest(2).collect()] == [25, 26]


def test_hook_fires_on_changes_alone(spark, tmp_path):
    schema = "link string, title string, seen int, at int"
    log = KeyedLog(spark, f"file://{tmp_path}/kept", schema, ["link"])
    fired = []

    def put(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        writer = kept.on_change(stream, log, [F.desc("at")], ["title"], lambda d, n: fired.append((n, sorted((r.link, r.title) for r in d.collect()))), compact_every=2)
        writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    put(("a", "A", 1, 1), ("b", None, 1, 1), ("a", "old", 1, 0))
    put(("a", "A", 2, 2), ("b", None, 2, 2))  # seen again, nothing of matching
    put(("a", "A2", 3, 3), ("c", "C", 1, 3), ("b", "B", 3, 3))
    put(("b", None, 4, 4))
    assert fired == [(0, [("a", "A"), ("b", None)]), (2, [("a", "A2"), ("b", "B"), ("c", "C")]), (3, [("b", None)])]
    assert {(r.link, r.title) for r in log.current().collect()} == {("a", "A2"), ("b", None), ("c", "C")}
    before = (list(fired), log.current().collect())
    assert not log.commit(spark.createDataFrame([("a", "other", 9, 9)], schema), 4)  # a batch that counts is left alone
    assert (list(fired), log.current().collect()) == before


def test_a_hook_that_failed_is_called_again(spark, tmp_path):
    schema = "link string, title string, at int"
    log = KeyedLog(spark, f"file://{tmp_path}/kept", schema, ["link"])
    spark.createDataFrame([("a", "A", 1)], schema).write.parquet(f"{tmp_path}/in")
    calls = []

    def hook(d, n):
        calls.append((n, [r.link for r in d.collect()]))
        if len(calls) == 1:
            raise RuntimeError("lost")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        kept.on_change(stream, log, [F.desc("at")], ["title"], hook).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    assert log.current().count() == 0  # written, not counted
    run()
    assert calls == [(0, ["a"]), (0, ["a"])] and log.current().count() == 1
    run()
    assert len(calls) == 2


def test_merged_streams_carry_their_names(spark, stream):
    s = stream(rows(20))
    both = events.merged({"one": s.where("user_id = 0"), "two": s.where("user_id <> 0").select("event_id", "ts")})
    got = {(r.event_id, r.stream) for r in events.run(both.select("event_id", "stream")).collect()}
    assert got == {(i, "one" if k == 0 else "two") for i, _, k, _, _ in rows(20)}


def test_pauses_keep_one_timer_a_key():
    """A timer for each pause made every one of them read and write the key's whole list."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from folium.streaming import stateful

    class Handle:
        def __init__(self):
            self.rows, self.timers, self.calls = [], set(), 0

        def getListState(self, name, schema):
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.calls = list(rows), self.calls + 1

        def clear(self):
            self.put([])

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    h, p = Handle(), stateful.Pauses()
    p.init(h)
    notice = Row("at", "until", "answer")
    p.handleInputRows(("k",), iter([notice(100 * i, 100 * i + 50, "a") for i in range(1, 41)]), None)
    assert h.timers == {150}
    p.handleInputRows(("k",), iter([notice(10, 20, "b"), notice(120, 170, "c")]), None)
    assert h.timers == {20}
    told, now = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: 2_000)
    while h.timers and min(h.timers) <= 2_000:
        at = min(h.timers)
        h.timers.remove(at)
        told += [tuple(r) for r in p.handleExpiredTimer(("k",), now, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))]
    assert told == [("k", 10, 20, "b"), ("k", 100, 170, "a"), *(("k", 100 * i, 100 * i + 50, "a") for i in range(2, 20))]
    assert h.timers == {2_050} and h.calls == 3


def waiting(spark, out):
    """What waits in the state of the query that wrote ``out``."""
    path = out.inputFiles()[0].rsplit("/out/", 1)[0]
    return spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(f"{path}/state")


def test_rows_wait_in_parts(spark, stream):
    """Each row went to Python, into the state and back by itself, which was most of the time of a stream."""
    data = rows(600, seed=11)
    stateful.with_timers(spark)
    got = events.run(stateful.throttled(stream(data, files=1), gap_ms=1_000, delay="90 minutes"))
    passed = max(ms(r[1]) for r in data) - 5_400_000
    told = {(k, i) for _, k, i in [(r.at, r.key, r.event_id) for r in got.collect()]}
    last, want = {}, set()
    for i, t, k, _, _ in data:
        if ms(t) <= passed and (k not in last or ms(t) - last[k] >= 1_000):
            last[k] = ms(t)
            want.add((k, i))
    assert told == want
    assert waiting(spark, got).count() <= len({r[2] for r in data}) < sum(ms(r[1]) > passed for r in data)


def test_hot_key_in_many_parts(spark, stream):
    """Parts of one key that come in one batch and over batches are folded as if all rows had come in order."""
    data = [(i, START + timedelta(milliseconds=(i * 7919) % 2_500 * 1_000), i % 50 // 49, "ok", None) for i in range(2_500)]
    got = stateful.run_to_end(stream(data, files=2), lambda s: stateful.throttled(s, gap_ms=3_000))
    last, want = {}, set()
    for i, t, k, _, _ in sorted(data, key=lambda r: (r[1], r[0])):
        if k not in last or ms(t) - last[k] >= 3_000:
            last[k] = ms(t)
            want.add((k, i, ms(t)))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert waiting(spark, got).count() == 0


def test_late_rows_of_a_part(spark, tmp_path):
    """A part holds late rows beside others: those that the watermark had passed are dropped, the others are not."""
    at = lambda m: START + timedelta(minutes=m)
    batches = [[(0, 0), (1, 10), (2, 180)], [(3, 170), (4, 300)], [(5, 130), (6, 250), (7, 360)]]
    for batch in batches:
        spark.createDataFrame([(i, at(m), 1, "ok", None) for i, m in batch], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = stateful.run_to_end(source, lambda s: stateful.throttled(s, gap_ms=1_200_000))
    assert sorted(r.event_id for r in got.collect()) == [0, 3, 4, 6, 7]


@pytest.mark.parametrize("name", ["stream_throttle", "stream_replay_dedup"])
def test_files_in_any_order(spark, tmp_path, name):
    """Twenty files that all span the whole time: those after the first eight were late."""
    import duckdb

    import __spark_entry__ as entry

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(20, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
