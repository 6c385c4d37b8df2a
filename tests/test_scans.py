from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folium.operators import limits, ordered, scans


@pytest.fixture
def many_ranges(spark):
    """Small ranges, so that keys go over several."""
    conf = {"spark.sql.shuffle.partitions": "11", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_running_values_equal_a_loop(spark, many_ranges):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.choice([None, rng.randrange(-9, 9)])) for i in range(400)]
    rng.shuffle(rows)
    d = scans.pieces(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"])
    got = scans.running(d, ["k"], ["i"], s=("sum", "v"), n=("count", F.lit(1)), lo=("min", "v"), hi=("max", "v"), la=("last", "v"), la0=("last", "v", False), n0=("count", F.lit(1), False), s0=("sum", "v", False))
    assert d.select("_piece").distinct().count() > 4 and d.where("k = 'hot'").select("_piece").distinct().count() > 2
    want, past = [], {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        before = [x for x in past.get(k, []) if x is not None]
        n0 = len(past.setdefault(k, []))
        past[k].append(v)
        upto = [x for x in past[k] if x is not None]
        some = lambda f, x: f(x) if x else None
        want.append((k, i, some(sum, upto), n0 + 1, some(min, upto), some(max, upto), some(lambda x: x[-1], upto), some(lambda x: x[-1], before), n0, some(sum, before)))
    assert sorted((tuple(r) for r in got.select("k", "i", "s", "n", "lo", "hi", "la", "la0", "n0", "s0").collect()), key=lambda r: r[1]) == want


def test_numbers_and_moves(spark, many_ranges):
    rows = [(i * 3, "waiting" if i % 3 else "done") for i in range(120)]
    d = spark.createDataFrame(rows, "id long, status string").repartition(5)
    assert [r.id for r in ordered.moved_to_front(d, "id", "id", [9, 300, 9, 5]).orderBy("position").collect()] == [9, 300] + [i for i, _ in rows if i not in (9, 300)]
    assert scans.numbered(d.limit(0), ["id"]).collect() == []
    waiting = [i for i, s in rows if s == "waiting"]
    for chosen in (waiting[0], waiting[40], waiting[-1], 0, 7):
        for to in ordered.MOVES:
            line = list(waiting)
            if chosen in line:
                at = line.index(chosen)
                goal = {"top": 0, "up": at - 1, "down": at + 1, "bottom": len(line) - 1}[to]
                line.insert(max(0, min(goal, len(line) - 1)), line.pop(at))
            rest = iter(line)
            want = [next(rest) if s == "waiting" else i for i, s in rows]
            if to in ("up", "bottom") or chosen == waiting[40]:
                got = ordered.move_waiting(d, "id", "id", F.col("status") == "waiting", chosen, to).orderBy("place").collect()
                assert [r.id for r in got] == want and [r.place for r in got] == [i for i, _ in rows]
    with pytest.raises(ValueError):
        ordered.move_waiting(d, "id", "id", F.lit(True), 0, "left")


def test_streaks(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False), ("c", 1, True), (None, 1, True), (None, 0, False)]
    d = spark.createDataFrame(rows, "k string, i int, bad boolean")
    assert {tuple(r) for r in ordered.failure_streak(d, "k", ["i"], F.col("bad")).collect()} == {("a", 2), ("b", 0), ("c", 1), (None, 1)}


def folded(requests, rates):
    """Each request waits its turn: time goes by in steps to the next change of rate, paying what is owed."""
    out = {}
    for key in {r[0] for r in requests}:
        changes = sorted((at, kbps * 1024) for k, at, kbps in rates if k == key)
        rate_at = lambda t: next((r for a, r in reversed(changes) if a <= t), 0)
        free, owed_ms = 0, 0  # when the line is empty, in exact work left at that time
        line = sorted((at, i, size) for k, i, at, size in requests if k == key)
        t, left = 0, 0  # time, and work not paid yet
        targets = []  # (work to be paid in all, id)
        taken = paid = 0
        moments = sorted({at for at, _, _ in line} | {a for a, _ in changes})
        for m, after in zip(moments, [*moments[1:], None]):
            for at, i, size in line:
                if at == m:
                    taken += size * 1000
                    targets.append((taken, i))
            rate = rate_at(m)
            if rate == 0:
                paid = taken
                for _, i in targets:
                    out[key, i] = m
                targets = []
                continue
            for want, i in list(targets):
                goes = m + -(-(want - paid) // rate)
                if after is None or goes <= after:
                    out[key, i] = goes
                    targets.remove((want, i))
            if after is not None:
                paid = min(taken, paid + (after - m) * rate)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_limit_equals_a_fold(spark, many_ranges, seed):
    rng = random.Random(seed)
    requests = [("hot" if i % 2 else rng.choice("abc"), i, rng.randrange(60_000), rng.choice([0, 1, 1024, 10_240, 50_000, rng.randrange(90_000)])) for i in range(300)]
    rates = [(k, rng.randrange(60_000), rng.choice([0, 1, 10, 50, 400])) for k in ("hot", "a", "b") for _ in range(6)] + [("hot", 0, 60), ("none", 5, 5)]
    rates = list({(k, at): (k, at, kbps) for k, at, kbps in rates}.values())
    got = limits.shared_limit(spark.createDataFrame(requests, "key string, id long, at long, bytes long"), spark.createDataFrame(rates, "key string, at long, kbps int"))
    assert {(r.key, r.id): r.goes_at for r in got.collect()} == folded(requests, rates)


def test_four_seconds_worth_takes_four_seconds(spark):
    requests = spark.createDataFrame([("m", i, 1_700_000_000_000, 10 * 1024) for i in range(4)], "key string, id long, at long, bytes long")
    rates = spark.createDataFrame([("m", 0, 10)], "key string, at long, kbps int")
    assert sorted(r.goes_at - 1_700_000_000_000 for r in limits.shared_limit(requests, rates).collect()) == [1000, 2000, 3000, 4000]
    assert {r.goes_at - 1_700_000_000_000 for r in limits.shared_limit(requests, rates.limit(0)).collect()} == {0}
    twice = spark.createDataFrame([("m", 0, 10), ("m", 1_700_000_002_500, 20), ("m", 1_700_000_003_000, 0)], "key string, at long, kbps int")
    assert sorted(r.goes_at - 1_700_000_000_000 for r in limits.shared_limit(requests, twice).collect()) == [1000, 2000, 2750, 3000]


def test_sort_keys_are_columns(spark):
    """A key that stands in the sort itself is made for both sides of every comparison."""
    from folium.operators import queue

    tasks = spark.createDataFrame([(i, f"a{i % 3}", "x", i % 2, 2, 1.0, "m", "/d", i) for i in range(6)], "place long, title string, status string, done long, total long, bytes_per_sec double, module_id string, save_to string, date_added long")
    got = queue.sorted_tasks(tasks, "title", True).limit(3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    order = plan[plan.index("orderBy=") : plan.index("]", plan.index("orderBy="))]
    assert "regexp" not in order and "_key" in order
    assert [r.place for r in got.collect()] == [5, 2, 4] and got.columns == tasks.columns
