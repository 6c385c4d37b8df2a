"""Queries of imports and of the clean-up of series, each beside the SQL that gives its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import series
from folium.schemas import spread, table
from folium.sources import imports


def _downloads(spark, sf):
    """Orders as an older program's downloads: lines as chapters in joined columns, dates in four forms."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("l"))
    joined = lambda f, end: F.array_join(F.transform("l", f), end)
    day = F.to_date("o_orderdate")
    n = F.col("o_orderkey")
    dates = F.when(n % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(n % 4 == 1, (F.datediff(day, F.lit("1970-01-01").cast("date")) + 25_569).cast("string")).when(n % 4 == 2, F.date_format(day, "d-M-yyyy")).otherwise(F.date_format(day, "M/d/yyyy"))
    d = table(spark, sf, "orders").join(lines, F.col("l_orderkey") == n)
    return d.select(
        n.alias("place"), (n % 2).cast("string").alias("enabled"), (n % 10).cast("string").alias("taskstatus"), (n % 5).cast("string").alias("chapterptr"), F.lit("7").alias("currentpage"),
        F.col("o_orderpriority").alias("moduleid"), F.concat(F.lit("/o/"), n.cast("string")).alias("link"), F.when(n % 6 != 0, F.col("o_orderstatus")).alias("title"),
        F.concat(F.when(n % 3 == 0, F.lit("D:\\comics\\")).when(n % 3 == 1, F.lit("D:\\")).otherwise(F.lit("/else/")), n.cast("string")).alias("saveto"),
        dates.alias("dateadded"), F.lit(None).cast("string").alias("datelastdownloaded"),
        F.concat(joined(lambda x: F.concat(F.lit("/c"), x["l_partkey"].cast("string")), "\r\n"), F.lit("\r\n")).alias("chapterslinks"),
        joined(lambda x: F.concat(F.lit("Line "), x["l_linenumber"].cast("string")), "\n").alias("chaptersnames"),
        F.array_join(F.slice(F.transform("l", lambda x: F.when(x["l_returnflag"] == "R", "F").when(x["l_returnflag"] == "A", "D").otherwise("P")), 1, 2), "\n").alias("chaptersstatus"),
        F.lit("W\nD\nhttps://x.org/3").alias("pagelinks"), F.lit("c1\nc2").alias("pagecontainerlinks"), F.lit("f1").alias("filenames"), F.when(n % 4 == 0, F.lit("%MANGA%")).alias("customfilenames"),
    )


def _imported(spark, sf):
    paths = spark.createDataFrame([("D:\\", "/mnt/"), ("D:\\comics\\", "/library/")], "prefix string, target string")
    return imports.imported(_downloads(spark, sf), paths, "UTC")


def imported_tasks(spark, sf):
    """Tasks of an older download table: codes to states, folders by the longest prefix, dates of four forms."""
    t = _imported(spark, sf)["tasks"]
    return t.select("place", "module_id", "title", "save_to", "status", "enabled", F.unix_millis("date_added").alias("added_ms"), "current_chapter")


def imported_chapters(spark, sf):
    """Chapters of an older download table, out of lines of joined columns."""
    return _imported(spark, sf)["chapters"].select("place", "chapter", "link", "name", "custom_filename", "status", "current_page")


def imported_pages(spark, sf):
    """Pages of the current chapters of an older download table."""
    return _imported(spark, sf)["pages"].select("place", "chapter", "page", "url", "container_url", "filename", "status")


def cleaned_series(spark, sf):
    """All ten fields of series made of parts, cleaned."""
    p = spread(table(spark, sf, "part"))
    n, text = F.col("p_partkey"), F.col("p_name")
    raw = p.select(
        n.alias("id"), F.concat(F.lit("https://x.org/s/"), n.cast("string")).alias("url"), F.when(n % 3 == 0, F.concat(F.lit("/own/"), n.cast("string"))).alias("link"),
        F.when(n % 5 != 0, F.concat(F.lit(" \r\n"), text, F.lit("\u00a0 &amp; "), F.col("p_type"), F.lit("\\n "))).otherwise(" \n").alias("title"),
        F.when(n % 4 == 0, "-").when(n % 4 == 1, F.concat(F.lit("<b>"), text)).otherwise(text).alias("alt_titles"), F.concat(F.lit(":https:///c.org//"), n.cast("string"), F.lit("///x.jpg")).alias("cover_link"),
        F.concat(F.col("p_type"), F.lit(",\ufeff "), F.col("p_brand"), F.lit(",,\n")).alias("authors"), F.when(n % 2 == 0, ":").alias("artists"), F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand"), F.lit(",")).alias("genres"),
        (n % 4).cast("string").alias("status"), F.when(n % 7 == 0, " - ").otherwise(F.concat(text, F.lit("\r\n\r\n\r\n"), F.col("p_type"), F.lit("\n\n\nend "))).alias("summary"),
    )
    return series.clean_series(raw)


def series_chapters(spark, sf):
    """Chapters of all orders as series: of links that differ in case the last stays, names lose the title before them."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("l"))
    links = F.transform("l", lambda x: F.concat(F.when(x["l_linenumber"] % 2 == 0, "https://x.org/c").otherwise("/C"), (x["l_partkey"] % 5).cast("string")))
    names = F.transform("l", lambda x: F.concat(F.when(x["l_linenumber"] % 3 == 0, "TALE - ").otherwise(" "), F.lit("Ch\t "), x["l_linenumber"].cast("string")))
    raw = lines.select("l_orderkey", F.lit("Tale").alias("title"), links.alias("chapter_links"), names.alias("chapter_names"))
    return series.chapters_of(raw, "l_orderkey", drop_title=True)


_LINES = "SELECT l_orderkey, l_linenumber n, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 i, count(*) OVER (PARTITION BY l_orderkey) c FROM lineitem"
Q, S = {}, {}
for _f, _sql in (
    (
        imported_tasks,
        r"""SELECT o_orderkey place, o_orderpriority module_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus ELSE '' END title, CASE o_orderkey % 3 WHEN 0 THEN '/library/' WHEN 1 THEN '/mnt/' ELSE '/else/' END || o_orderkey save_to,
        CASE WHEN o_orderkey % 10 IN (4) THEN 'finished' WHEN o_orderkey % 10 IN (7, 8) THEN 'failed' ELSE 'stopped' END status, o_orderkey % 2 = 1 enabled,
        CASE WHEN o_orderkey % 4 = 0 THEN epoch_us(date_trunc('second', o_orderdate)) // 1000 ELSE epoch_us(date_trunc('day', o_orderdate)::TIMESTAMP) // 1000 END added_ms, o_orderkey % 5 current_chapter
        FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    ),
    (
        imported_chapters,
        f"""SELECT l_orderkey place, i::INT chapter, '/c' || l_partkey AS link, 'Line ' || n AS name, CASE WHEN o_orderkey % 4 = 0 THEN '%MANGA%' END custom_filename,
        CASE WHEN i < 2 THEN CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'downloaded' ELSE 'pending' END WHEN i < o_orderkey % 5 - 1 THEN 'downloaded' ELSE 'pending' END status, CASE WHEN i = o_orderkey % 5 THEN 7 ELSE 0 END::BIGINT current_page
        FROM ({_LINES}) JOIN orders ON o_orderkey = l_orderkey""",
    ),
    (imported_pages, f"SELECT DISTINCT l_orderkey place, (o_orderkey % 5)::INT chapter, p::INT AS page, ['', '', 'https://x.org/3'][p + 1] url, ['c1', 'c2', ''][p + 1] container_url, ['f1', '', ''][p + 1] filename, ['waiting', 'downloaded', 'waiting'][p + 1] status FROM ({_LINES}) JOIN orders ON o_orderkey = l_orderkey, range(3) r(p) WHERE o_orderkey % 5 < c"),
    (
        cleaned_series,
        r"""SELECT p_partkey id, 'https://x.org/s/' || p_partkey url, CASE WHEN p_partkey % 3 = 0 THEN '/own/' ELSE '/s/' END || p_partkey link, CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' & ' || p_type ELSE 'N/A' END title,
        CASE WHEN p_partkey % 4 < 2 THEN '' ELSE p_name END alt_titles, 'https://c.org/' || p_partkey || '/x.jpg' cover_link, p_type || ', ' || p_brand authors, '' artists, p_type || ', ' || p_brand genres, (p_partkey % 4)::VARCHAR status,
        CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || chr(13) || chr(10) || p_type || chr(10) || 'end' END summary FROM part""",
    ),
    (
        series_chapters,
        f"""WITH d AS (SELECT l_orderkey, i, n, CASE WHEN n % 2 = 0 THEN '/c' ELSE '/C' END || l_partkey % 5 AS link, CASE WHEN n % 2 = 0 THEN 'https://x.org/c' ELSE '/c' END || l_partkey % 5 k, 'Ch ' || n AS name FROM ({_LINES})),
        l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, k ORDER BY i DESC) r FROM d)
        SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1)::INT AS position, link, name FROM l WHERE r = 1""",
    ),
):
    Q[_f.__name__], S[_f.__name__] = _f, _sql
