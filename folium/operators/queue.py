"""Queue, inbox and log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import natural_key
from folium.operators.ordered import keep_least

#: Log levels by severity, the worst first.
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")


def group_counts(tasks: DataFrame, group: Column, names: list[str]) -> DataFrame:
    """Tasks per group in one row, groups without tasks as zero."""
    return tasks.agg(*[F.count_if(group == n).alias(n) for n in names])


def rollup(chapters: DataFrame) -> DataFrame:
    """Per task: chapters, finished ones, pages and pages done, and the progress label."""
    d = chapters.groupBy("task_id").agg(F.count("*").alias("n_chapters"), F.count_if("done").alias("n_done"), F.sum("pages").alias("pages"), F.sum(F.when(F.col("done"), F.col("pages")).otherwise(0)).alias("pages_done"))
    return d.withColumn("label", F.concat(F.col("n_done").cast("string"), F.lit("/"), F.col("n_chapters").cast("string")))


def newest(events: DataFrame, limit: int, kind: str | None = None, unread: bool = False) -> DataFrame:
    """Newest first; a limit below zero is none."""
    d = events.where(F.col("kind") == kind) if kind is not None else events
    d = d.where(~F.col("read")) if unread else d
    d = d.orderBy(F.desc("ts"), F.desc("id"))
    return d if limit < 0 else d.limit(limit)


def after(events: DataFrame, last: int, limit: int) -> DataFrame:
    """The page of ids after ``last``."""
    return events.where(F.col("id") > last).orderBy("id").limit(limit)


def at_least(level: str, column: str = "level") -> Column:
    """Lines at least as severe."""
    return F.col(column).isin(*LEVELS[: LEVELS.index(level) + 1])


def tail(lines: DataFrame, limit: int, cursor: int | None = None) -> DataFrame:
    """The newest lines, or the oldest after a cursor, always in order."""
    if cursor is not None:
        return lines.where(F.col("seq") > cursor).orderBy("seq").limit(limit)
    return lines.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def tasks_page(tasks: DataFrame, chapters: DataFrame, text: str, since: Column, until: Column) -> DataFrame:
    """Tasks with the text in their title, module or any chapter's name, and last worked on, else added, in a range."""
    low = text.lower()
    named = chapters.where(F.contains(F.lower("name"), F.lit(low))).select("task_id").distinct().withColumn("_named", F.lit(True))
    hit = F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("module_id"), F.lit(low)) | F.coalesce("_named", F.lit(False))
    return tasks.where(F.coalesce("last_at", "added_at").between(since, until)).join(named, "task_id", "left").where(hit).drop("_named")


def log_search(lines: DataFrame, text: str, level: str) -> DataFrame:
    """Lines at least as severe with the text in message, target or module, case ignored."""
    hit = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower())) for c in ("message", "target", "module")]
    return lines.where(at_least(level) & (hit[0] | hit[1] | hit[2]))


def merged_lines(kept: DataFrame, more: DataFrame, most: int) -> DataFrame:
    """Lines of both, each number once and as it was kept, the newest ``most`` of them."""
    both = kept.withColumn("_from", F.lit(0)).unionByName(more.withColumn("_from", F.lit(1)))
    return keep_least(both, ["seq"], ["_from"]).drop("_from").orderBy(F.desc("seq")).limit(most)


def retries(chapters: DataFrame, tasks: DataFrame, most: int) -> DataFrame:
    """Tasks to run again: the first failed chapter of each that has been tried again fewer than ``most`` times."""
    first = chapters.where("failed").groupBy("task_id").agg(F.min("position").alias("chapter"))
    return tasks.where(F.col("retried") < most).join(first, "task_id").select("task_id", "chapter", (F.col("retried") + 1).alias("retried"))


def total_rate(tasks: DataFrame) -> DataFrame:
    """The rate of all active tasks together."""
    return tasks.agg(F.coalesce(F.sum(F.when(F.col("active"), F.col("rate"))), F.lit(0.0)).alias("rate"))


def window_open(seconds: Column, start: int, end: int) -> Column:
    """Whether a second of the day lies in a daily window, which may pass midnight; equal ends are always open."""
    if start == end:
        return F.lit(True)
    return (seconds >= start) & (seconds < end) if start < end else (seconds >= start) | (seconds < end)


DAY = 86_400


def until_open(seconds: Column, start: int, end: int) -> Column:
    """Seconds from a second of the day until a daily window opens, past midnight too; null while it is open."""
    wait = F.lit(start) - seconds
    return F.when(~window_open(seconds, start, end), F.when(wait > 0, wait).otherwise(wait + DAY))


#: The columns that tasks are sorted by, and the states' words.
TASK_SORTS = ("queue", "title", "status", "progress", "speed", "website", "save_to", "added")


def sorted_tasks(tasks: DataFrame, by: str, desc: bool = False) -> DataFrame:
    """``tasks`` by a named column, ties in queue order; the other way round, ties are too.

    Text compares naturally, progress as ``done/total``, the speed as a number, the time added as a time. Columns:
    place, title, status, done, total, bytes_per_sec, module_id, save_to, date_added.
    """
    if by not in TASK_SORTS:
        raise ValueError(f"no such sort: {by}")
    progress = F.concat(F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"))
    text = {"title": F.col("title"), "status": F.col("status"), "progress": progress, "website": F.col("module_id"), "save_to": F.col("save_to")}
    keys = [natural_key(text[by])] if by in text else [F.col({"speed": "bytes_per_sec", "added": "date_added"}[by])] if by != "queue" else []
    keyed = tasks.select("*", *[k.alias("_key") for k in keys])  # a column, else every comparison would make both sides' keys anew
    order = [F.col(c) for c in (*["_key" for _ in keys], "place")]
    return keyed.orderBy(*[k.desc() if desc else k.asc() for k in order]).drop("_key")
