"""Operators over ordered rows: runs, streaks, first and last rows, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.operators.scans import numbered, pieces, running
from folium.shared import cut


def keep_one(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Spark cuts each task's rows to the first of a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_least(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ascending order of some columns. It is combined before the shuffle, so that a hot
    key costs each task one row."""
    names = rows.columns
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return least.select(*[F.col("_r")[c].alias(c) for c in names])


def appended(old: DataFrame, new: DataFrame, group: str, order: str, place: str) -> DataFrame:
    """New rows with the places after the highest one of their group, or from 0, in the given order."""
    top = old.groupBy(group).agg((F.max(place) + 1).alias("_next"))
    d = new.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).join(top, group, "left")
    return d.withColumn(place, F.coalesce("_next", F.lit(0)) + F.col("_n")).drop("_next", "_n")


def runs(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Runs of values at most one apart, per group: first, last and length. A group's rows may lie in many ranges."""
    d = running(pieces(rows.select(group, value), [group], [value]), [group], [value], _before=("last", value, False))
    step = F.col(value) - F.col("_before")
    d = d.withColumn("_new", F.when((step > 0) & (step <= 1), 0).otherwise(1))
    d = running(d, [group], [value], run=("sum", "_new"))
    return d.groupBy(group, "run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("run")


_NUMBER = r"^(.*?)([0-9]+(?:\.[0-9]+)?)([^0-9]*)$"


def label_runs(rows: DataFrame, group: str, position: str, name: str) -> DataFrame:
    """One line per group for its ordered names: names of one wording whose numbers rise by at most one are shortened
    to ``first – last``; the line ends in the number of names, and a single name stands alone."""
    w = Window.partitionBy(group).orderBy(position)
    d = rows.select(group, position, name, F.regexp_extract(name, _NUMBER, 1).alias("_head"), F.regexp_extract(name, _NUMBER, 2).alias("_num"), F.regexp_extract(name, _NUMBER, 3).alias("_tail"))
    step = F.col("_num").try_cast("decimal(38,9)") - F.lag(F.col("_num").try_cast("decimal(38,9)")).over(w)
    same = (F.lag("_head").over(w) == F.col("_head")) & (F.lag("_tail").over(w) == F.col("_tail")) & (step > 0) & (step <= 1)
    d = d.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = d.groupBy(group, "_run").agg(F.min(position).alias("_at"), F.count("*").alias("_n"), F.min_by(name, position).alias("_a"), F.max_by(name, position).alias("_b"), F.max_by("_num", position).alias("_bn"), F.first("_tail").alias("_tail"))
    # the last name of a run without a tail shows its number alone
    text = F.when(F.col("_n") == 1, F.col("_a")).otherwise(F.concat_ws(" – ", "_a", F.when(F.col("_tail") == "", F.col("_bn")).otherwise(F.col("_b"))))
    line = F.transform(F.sort_array(F.collect_list(F.struct("_at", text.alias("t")))), lambda x: x["t"])
    out = one.groupBy(group).agg(F.array_join(line, ", ").alias("_t"), F.sum("_n").alias("_n"))
    return out.select(group, F.when(F.col("_n") == 1, F.col("_t")).otherwise(F.concat("_t", F.lit(" ("), F.col("_n").cast("string"), F.lit(" chapters)"))).alias("label"))


def failure_streak(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Failures since the last success, per key: the last success is an aggregate, and so is the count after it."""
    at = F.struct(*order)
    d = rows.select(key, at.alias("_at"), failed.alias("_f"))
    last = d.groupBy(F.col(key).alias("_k")).agg(F.max(F.when(~F.col("_f"), F.col("_at"))).alias("_last"))
    after = F.col("_f") & (F.col("_last").isNull() | (F.col("_at") > F.col("_last")))
    return d.join(last, F.col(key).eqNullSafe(F.col("_k"))).groupBy(key).agg(F.count_if(after).alias("streak"))


def moved_to_front(rows: DataFrame, key: str, order: str, front: list) -> DataFrame:
    """Dense new positions: the listed keys first, in their order, then the rest as before."""
    rank = F.coalesce(*[F.when(F.col(key) == F.lit(k), F.lit(i)) for i, k in enumerate(front)], F.lit(len(front)))
    return numbered(rows.withColumn("_rank", rank), ["_rank", order, key]).drop("_rank").withColumn("position", F.col("position").cast("int"))


def masked_move(rows: DataFrame, order: str, movable: Column, new_rank: Column) -> DataFrame:
    """Movable rows take each other's places by a new rank; the others keep theirs. Places are numbered, and joined by number."""
    d = rows.withColumn("_m", movable)
    places = numbered(d.where("_m").select(F.col(order).alias("place")), ["place"], "_n")
    moved = numbered(d.where("_m").withColumn("_rank", new_rank), ["_rank", order], "_n").drop("_rank").join(places, "_n").drop("_n")
    return moved.unionByName(d.where("NOT _m").withColumn("place", F.col(order))).drop("_m")


#: Where a waiting row may be taken among the waiting ones.
MOVES = ("top", "up", "down", "bottom")


def move_waiting(rows: DataFrame, key: str, order: str, waiting: Column, chosen, to: str) -> DataFrame:
    """``rows`` with their ``place`` after the chosen waiting one is moved among the waiting ones, which swap places;
    all others stay. A row that is not there, or not waiting, moves nothing. Only rows between both places change."""
    if to not in MOVES:
        raise ValueError(f"no such move: {to}")
    d = rows.withColumn("_w", F.coalesce(waiting, F.lit(False)))
    held = cut(numbered(d.where("_w"), [order, key], "_n"))
    n = held.count()
    found = held.where(F.col(key) == F.lit(chosen)).select("_n").first()
    if found is None:
        return rows.withColumn("place", F.col(order))
    at = found[0]
    goal = max(0, min({"top": 0, "up": at - 1, "down": at + 1, "bottom": n - 1}[to], n - 1))
    i = F.col("_n")
    new = F.when(i == at, goal).when((i > at) & (i <= goal), i - 1).when((i < at) & (i >= goal), i + 1).otherwise(i)
    places = held.select(F.col("_n").alias("_new"), F.col(order).alias("place"))
    moved = held.withColumn("_new", new).join(places, "_new").select(*rows.columns, "place")
    return moved.unionByName(d.where("NOT _w").select(*rows.columns, F.col(order).alias("place")))
