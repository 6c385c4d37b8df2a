"""One rate limit shared by all requests of a key: when each of them may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.operators.scans import PIECE, pieces, running

#: Bytes of a kilobyte, and milliseconds of a second: work is counted in bytes x ms/s, so that time x rate is exact.
KB, SECOND = 1024, 1000
_WIDE = "decimal(38,0)"


def shared_limit(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """``key, id, goes_at``: when each of ``requests (key, id, at, bytes)`` is paid for, under ``rates (key, at, kbps)``.

    Times are in milliseconds. A request is paid for after the ones before it, by (at, id), at the rate of the day: a
    rate holds from its time on, also for those that wait. No rate yet, and a rate of 0, is no limit. Idle time is not
    saved up. All numbers are whole and exact: a request goes at the first millisecond at which it is paid.

    What is paid at an event is the least, over all events up to it, of the work taken before that one and the capacity
    since: a running minimum of running sums, so that a key's events are dealt to ranges like any others. A second
    pass, in the order of work, finds for each request the last event at which it was not paid yet.
    """
    wide = lambda c: F.col(c).cast(_WIDE)
    events = requests.select("key", F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), (wide("bytes") * SECOND).cast(_WIDE).alias("work"), F.lit(None).cast("long").alias("rate"))
    # of several rates of one instant the greatest number counts as the last one
    steps = rates.groupBy("key", "at").agg(F.max("kbps").alias("kbps"))
    events = events.unionByName(steps.select("key", F.col("at").cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast(_WIDE).alias("work"), (F.col("kbps").cast("long") * KB).alias("rate")))
    order = ["at", "kind", "id"]
    d = running(pieces(events, ["key"], order), ["key"], order, now=("last", "rate"), then=("last", "rate", False), before=("last", "at", False), taken=("sum", "work"))
    d = d.withColumn("now", F.coalesce("now", F.lit(0).cast("long")))
    idle = F.coalesce(((wide("at") - wide("before")) * wide("then")).cast(_WIDE), F.lit(0).cast(_WIDE))
    # where there is no limit, a row's own jump is as much as was ever taken: all is paid
    d = d.select("key", *order, "work", "now", "taken", PIECE, idle.alias("idle"), F.when(F.col("now") == 0, F.col("taken")).otherwise(F.lit(0).cast(_WIDE)).alias("jump"))
    d = running(d.withColumn("gain", (F.col("idle") + F.col("jump")).cast(_WIDE)), ["key"], order, capacity=("sum", "gain"))
    d = d.withColumn("upto", (F.col("capacity") - F.col("jump")).cast(_WIDE))
    d = running(d.withColumn("lead", (F.col("taken") - F.col("work") - F.col("upto")).cast(_WIDE)), ["key"], order, least=("min", "lead"))
    d = d.withColumn("paid", (F.col("upto") + F.col("least")).cast(_WIDE))

    points = d.select("key", F.col("paid").alias("amount"), F.lit(1).alias("kind"), "at", F.col("kind").alias("k"), "id", F.struct("at", "paid", F.col("now").alias("rate")).alias("point"))
    asked = d.where("kind = 1").select("key", F.col("taken").alias("amount"), F.lit(0).alias("kind"), "at", F.lit(1).alias("k"), "id", F.lit(None).cast(points.schema["point"].dataType).alias("point"))
    by_amount = ["amount", "kind", "at", "k", "id"]  # a request stands before the points at which it is paid
    d = running(pieces(points.unionByName(asked), ["key"], by_amount), ["key"], by_amount, last=("last", "point")).where("kind = 0")
    exact = F.expr("cast((amount - last.paid + last.rate - 1) div nullif(last.rate, 0) as bigint)")
    goes = F.col("last.at") + F.when(F.col("last.rate") == 0, F.lit(0).cast("long")).otherwise(exact)
    return d.select("key", "id", F.greatest("at", goes).alias("goes_at"))  # a request of no bytes may have been paid before it came
