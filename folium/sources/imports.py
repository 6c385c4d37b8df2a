"""Import of an older program's download table: joined columns to rows, codes to states, local times to UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.sources.io import local_to_utc, longest_prefix

#: Days from the older program's day 0 to 1970-01-01.
DAY_0 = 25_569
DOWNLOADED, FAILED, PENDING, WAITING = "downloaded", "failed", "pending", "waiting"


def text_lines(c: Column) -> Column:
    """The lines of a text: CR LF, LF and CR end one, a last line end begins no other, and empty ones between are kept."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r", -1))


def _clock(c: Column) -> Column:
    """Milliseconds of the day; null for what is no time, 0 for no text."""
    part = lambda i: F.regexp_extract(c, r"^(\d+):(\d+)(?::(\d+))?(?:[.,](\d{1,3}))?$", i)
    h, m, s = (F.coalesce(F.when(part(i) != "", part(i)).try_cast("long"), F.lit(0)) for i in (1, 2, 3))
    ms = F.coalesce(F.rpad(F.when(part(4) != "", part(4)), 3, "0").try_cast("long"), F.lit(0))
    return F.when(c == "", F.lit(0).cast("long")).when((part(1) != "") & (h <= 23) & (m <= 59) & (s <= 59), ((h * 60 + m) * 60 + s) * 1000 + ms)


def local_time(c: Column) -> Column:
    """A wall-clock time out of several forms, null for none: ISO, a number of days, D-M-Y or D.M.Y, and M/D/Y; the first two
    fields change places where the one that is the month cannot be. Day 0 at midnight stands for no time."""
    text = F.trim(c)
    iso = lambda i: F.regexp_extract(text, r"^(\d+)-(\d+)-(\d+)(?:[ T]\s*(.*))?$", i)
    part = lambda i: F.regexp_extract(text, r"^(\d+)([-./])(\d+)\2(\d+)(?: \s*(.*))?$", i)
    a, sep, b, y = part(1).try_cast("int"), part(2), part(3).try_cast("int"), part(4)
    year_last = F.length(y) == 4
    month_first = F.when(sep == "/", a <= 12).otherwise(b > 12)
    day = lambda y, m, d: F.datediff(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("long")
    iso_day = F.when(F.length(iso(1)) == 4, day(iso(1).try_cast("int"), iso(2).try_cast("int"), iso(3).try_cast("int")))
    iso_ms = iso_day * 86_400_000 + _clock(iso(4))
    days = text.try_cast("double")
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & (days != 0), F.round((days - DAY_0) * 86_400_000).cast("long"))
    other = F.when(~year_last, day(a, b, y.try_cast("int"))).when(month_first, day(y.try_cast("int"), a, b)).otherwise(day(y.try_cast("int"), b, a))
    ms = F.coalesce(F.when(iso_ms != -DAY_0 * 86_400_000, iso_ms), number, F.when(iso_ms.isNull(), other * 86_400_000 + _clock(part(5))))
    return F.timestamp_millis(ms)


def task_status(code: Column, resume: bool = False) -> Column:
    """A task's state; one that was in progress waits if ``resume``, else stops."""
    running = "waiting" if resume else "stopped"
    return F.when(code.isin(1, 2, 3, 5, 6), running).when(code == 4, "finished").when(code.isin(7, 8), "failed").otherwise("stopped")


def imported(downloads: DataFrame, paths: DataFrame, zone: str, resume: bool = False) -> dict[str, DataFrame]:
    """``tasks``, ``chapters`` and ``pages`` of ``downloads``, by ``place``; ``paths (prefix, target)`` rewrites folders.

    A task's chapters, their names and their markers are lines of three columns side by side; chapters before the
    current one, and without a marker, count as downloaded. Pages belong to the current chapter. Nulls count as empty.
    """
    d = downloads.withColumn("_now", F.coalesce(F.col("chapterptr").try_cast("long"), F.lit(0)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    to_utc = lambda c: local_to_utc(local_time(F.col(c).cast("string")), zone)
    moved = longest_prefix(d, "saveto", paths, "prefix")
    save_to = F.when(F.col("prefix").isNotNull(), F.concat("target", F.substr("saveto", F.length("prefix") + 1))).otherwise(text("saveto"))
    tasks = moved.select(
        "place", text("moduleid").alias("module_id"), text("link").alias("link"), text("title").alias("title"), save_to.alias("save_to"),
        task_status(F.coalesce(F.col("taskstatus").try_cast("long"), F.lit(0)), resume).alias("status"), F.coalesce(F.col("enabled").try_cast("long"), F.lit(0)).cast("boolean").alias("enabled"),
        F.coalesce(to_utc("dateadded"), F.timestamp_millis(F.lit(0))).alias("date_added"), to_utc("datelastdownloaded").alias("date_last_downloaded"), F.greatest("_now", F.lit(0)).alias("current_chapter"),
    )
    side = lambda c, i: F.coalesce(F.get(text_lines(F.col(c)), i), F.lit(""))
    one = F.transform(text_lines(F.col("chapterslinks")), lambda x, i: F.struct(i.alias("i"), x.alias("link"), side("chaptersnames", i).alias("name"), F.get(text_lines(F.col("chaptersstatus")), i).alias("mark")))
    template = F.when(F.trim(text("customfilenames")) != "", F.col("customfilenames"))
    mark = F.trim(F.coalesce("c.mark", F.when(F.col("c.i") < F.col("_now") - 1, "D").otherwise("P")))
    state = F.when(mark == "D", DOWNLOADED).when(mark == "F", FAILED).otherwise(PENDING)
    now = F.when(F.col("c.i") == F.col("_now"), F.coalesce(F.col("currentpage").try_cast("long"), F.lit(0))).otherwise(0)
    chapters = d.select("place", "_now", "currentpage", template.alias("custom_filename"), F.explode(one).alias("c"))
    chapters = chapters.select("place", F.col("c.i").alias("chapter"), "c.link", "c.name", "custom_filename", state.alias("status"), F.greatest(now, F.lit(0)).alias("current_page"))
    sheet = F.transform(text_lines(F.col("pagelinks")), lambda x, i: F.struct(i.alias("page"), x.alias("url"), side("pagecontainerlinks", i).alias("container_url"), side("filenames", i).alias("filename")))
    there = (F.col("_now") >= 0) & (F.col("_now") < F.size(text_lines(F.col("chapterslinks"))))
    pages = d.where(there).select("place", F.col("_now").cast("int").alias("chapter"), F.explode(sheet).alias("p")).select("place", "chapter", "p.*")
    pages = pages.withColumn("status", F.when(F.trim("url") == "D", DOWNLOADED).otherwise(WAITING)).withColumn("url", F.when(F.trim("url").isin("D", "W"), "").otherwise(F.col("url")))
    return {"tasks": tasks, "chapters": chapters, "pages": pages}
