from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from folium.functions import series
from folium.sources import imports

DOWNLOADS = "place int, enabled int, taskstatus int, chapterptr int, currentpage int, moduleid string, link string, title string, saveto string, dateadded string, datelastdownloaded string, chapterslinks string, chaptersnames string, pagelinks string, pagecontainerlinks string, filenames string, customfilenames string, chaptersstatus string"


def test_text_lines(spark):
    cases = {"": [], "a": ["a"], "a\n": ["a"], "a\r\nb\rc\nd": ["a", "b", "c", "d"], "a\n\nb": ["a", "", "b"], "\n": [""], "a\r\n\r\n": ["a", ""], None: []}
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    assert [r.l for r in d.select("i", imports.text_lines(F.col("t")).alias("l")).orderBy("i").collect()] == list(cases.values())


def test_local_times(spark):
    cases = {
        "2021-03-04 05:06:07": (2021, 3, 4, 5, 6, 7), "2021-03-04T05:06": (2021, 3, 4, 5, 6), "2021-03-04": (2021, 3, 4), " 2021-03-04 05:06:07.25 ": (2021, 3, 4, 5, 6, 7, 250_000),
        "4-3-2021 5:06:07": (2021, 3, 4, 5, 6, 7), "4.3.2021": (2021, 3, 4), "3/4/2021 05:06": (2021, 3, 4, 5, 6), "14/3/2021": (2021, 3, 14), "3-14-2021": (2021, 3, 14), "2021/3/14": (2021, 3, 14),
        "44259.5": (2021, 3, 4, 12), "25569": (1970, 1, 1), "0": None, "1899-12-30": None, "1899-12-30 01:00": (1899, 12, 30, 1), "": None, None: None, "soon": None, "2021-13-04": None, "2021-03-04 25:00": None, "1/2": None, "31-2-2021": None,
    }
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r.u for r in d.select("i", imports.local_time(F.col("t")).cast("timestamp_ntz").alias("u")).orderBy("i").collect()]
    assert dict(zip(cases, got)) == {c: None if w is None else datetime(*w) for c, w in cases.items()}


def test_import(spark):
    rows = [
        (1, 1, 2, 3, 7, "m", "/l", "T", "D:\\comics\\T", "2020-06-01 12:00:00", "44259.5", "/1\r\n/2\n/3\n/4\n", "one\ntwo\nthree", "W\nD\nhttps://x/3\n", "c1\nc2", "f1", " ", "D"),
        (2, None, 8, 0, 1, None, None, None, None, None, None, "/a", None, None, None, None, "%MANGA%", " F \n"),
        (3, 0, 4, 9, 0, "m", "/n", "N", "/else", "", "", "", "", "x", "", "", "", ""),
    ]
    paths = spark.createDataFrame([("D:\\", "/mnt/"), ("D:\\comics", "/library")], "prefix string, target string")
    got = imports.imported(spark.createDataFrame(rows, DOWNLOADS), paths, "Europe/Berlin")
    tasks = {r.place: r for r in got["tasks"].collect()}
    utc = lambda t: None if t is None else t.isoformat()
    assert (tasks[1].save_to, tasks[1].status, tasks[1].enabled, tasks[1].current_chapter) == ("/library\\T", "stopped", True, 3)
    shown = {r.place: (r.a, r.l) for r in got["tasks"].select("place", F.col("date_added").cast("timestamp_ntz").alias("a"), F.col("date_last_downloaded").cast("timestamp_ntz").alias("l")).collect()}
    assert (utc(shown[1][0]), utc(shown[1][1])) == ("2020-06-01T10:00:00", "2021-03-04T11:00:00") and (utc(shown[2][0]), shown[2][1]) == ("1970-01-01T00:00:00", None)
    assert (tasks[2].save_to, tasks[2].status, tasks[2].enabled, tasks[2].title) == ("", "failed", False, "") and tasks[3].status == "finished"
    chapters = [tuple(r) for r in got["chapters"].orderBy("place", "chapter").collect()]
    # markers up to the current chapter are filled in
    assert chapters == [(1, 0, "/1", "one", None, "downloaded", 0), (1, 1, "/2", "two", None, "downloaded", 0), (1, 2, "/3", "three", None, "pending", 0), (1, 3, "/4", "", None, "pending", 7), (2, 0, "/a", "", "%MANGA%", "failed", 1)]
    pages = [tuple(r) for r in got["pages"].orderBy("place", "page").collect()]
    assert pages == [(1, 3, 0, "", "c1", "f1", "waiting"), (1, 3, 1, "", "c2", "", "downloaded"), (1, 3, 2, "https://x/3", "", "", "waiting")]
    assert imports.imported(spark.createDataFrame(rows, DOWNLOADS), paths, "UTC", resume=True)["tasks"].where("place = 1").first().status == "waiting"


def test_series(spark):
    raw = [
        (1, "https://x.org/m/1", "", " A\r\n&amp;\u00a0B\\n ", "-", ":///x.org//c//1.jpg", "Ann,\u00a0Bo,, ", "<b>", "x, y,", " 1 ", "one\n\n\ntwo\r\n\r\n three "),
        (2, "https://x.org/m/2", "/own", None, ":", None, "-", None, None, None, " - "),
    ]
    d = spark.createDataFrame(raw, "i int, url string, link string, title string, alt_titles string, cover_link string, authors string, artists string, genres string, status string, summary string")
    got = {r.i: r for r in series.clean_series(d).collect()}
    assert (got[1].link, got[1].title, got[1].alt_titles) == ("/m/1", "A&B", "") and got[1].cover_link == "/x.org/c/1.jpg"
    assert (got[1].authors, got[1].artists, got[1].genres, got[1].status) == ("Ann,Bo", "", "x, y", " 1 ")
    assert got[1].summary == "one\ntwo\r\n three" and series.clean_series(d).columns == d.columns
    assert (got[2].link, got[2].title, got[2].alt_titles, got[2].authors, got[2].summary) == ("/own", "N/A", "", "", "")
    addresses = {"https:////a//b": "https://a/b", "//a.b//c": "a.b/c", ":x": "x", "a///b:///c": "a///b://c", "a///b": "a/b", "": "", " /x ": "/x"}
    a = spark.createDataFrame([(i, x) for i, x in enumerate(addresses)], "i int, t string")
    assert [r.u for r in a.select("i", series.clean_address(F.col("t")).alias("u")).orderBy("i").collect()] == list(addresses.values())


def test_chapters(spark):
    raw = [(1, "Tale", ["https://x.org/1", "/2 ", "/1", " ", "https://x.org/2", "/A"], ["tale - One", "Two\n\tand", "Tale One again", "lost", "TALE: Second &amp; last"]), (2, None, ["/a", "/b", "/A"], ["x", "y", "z"]), (3, "t", None, None)]
    d = spark.createDataFrame(raw, "id int, title string, chapter_links array<string>, chapter_names array<string>")
    got = [tuple(r) for r in series.chapters_of(d, "id").orderBy("id", "position").collect()]
    assert got == [(1, 0, "/1", "tale - One"), (1, 1, "/2", "Two and"), (1, 2, "/1", "Tale One again"), (1, 3, "/2", "TALE: Second & last"), (1, 4, "/A", ""), (2, 0, "/b", "y"), (2, 1, "/A", "z")]
    short = [tuple(r)[2:] for r in series.chapters_of(d, "id", drop_title=True).where("id = 1").orderBy("position").collect()]
    assert short == [("/1", "One"), ("/2", "Two and"), ("/1", "One again"), ("/2", ": Second & last"), ("/A", "")]


def test_book_metadata(spark):
    d = spark.createDataFrame([("manga", "safe", 1998), ("manhua", "erotica", 7), ("novel", "x", 0), ("", "", 10_000), (None, None, None)], "k string, r string, y int")
    got = [tuple(r) for r in d.select(series.reading_direction(F.col("k")), series.age_rating(F.col("r")), series.year_text(F.col("y"))).collect()]
    assert got == [("YesAndRightToLeft", "Everyone", "1998"), ("Yes", "Mature 17+", "0007"), ("Unknown", "Unknown", ""), (None, None, ""), (None, None, "")]
