from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folium.functions import clean, codecs, names, text
from folium.operators import compare, library, ordered, queue
from folium.sources import io, pages
from folium.streaming import events, stateful


@pytest.mark.parametrize(
    "names,label",
    [
        ([f"Chapter {i:04d}" for i in range(1, 48)], "Chapter 0001 – 0047 (47 chapters)"),
        (["Ch 1", "Ch 2", "Ch 3", "Ch 5", "Ch 7", "Ch 8", "Ch 9"], "Ch 1 – 3, Ch 5, Ch 7 – 9 (7 chapters)"),
        (["Ch. 12", "Ch. 12.5", "Ch. 13"], "Ch. 12 – 13 (3 chapters)"),
        (["Vol.1 Ch.3", "Vol.1 Ch.4", "Vol.2 Ch.5", "Vol.2 Ch.6"], "Vol.1 Ch.3 – 4, Vol.2 Ch.5 – 6 (4 chapters)"),
        (["Prologue", "Ch 1", "Ch 2", "Extra"], "Prologue, Ch 1 – 2, Extra (4 chapters)"),
        (["Ch 1 (raw)", "Ch 2 (raw)"], "Ch 1 (raw) – Ch 2 (raw) (2 chapters)"),
        (["Only"], "Only"),
    ],
)
def test_label_runs(spark, names, label):
    d = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "g int, i int, n string")
    assert ordered.label_runs(d, "g", "i", "n").first().label == label


@pytest.mark.parametrize("order", [["1.jpg", "2.jpg", "10.jpg", "page9", "page10", "x1y2", "x1y10"], ["0001", "001", "01", "1"], ["A9", "B1", "a10", "b2"], [" 2", "10"], ["A1.jpg", "a1.jpg"], ["x" + "9" * 21, "x1" + "0" * 21], ["0" * 120 + "1", "0" * 9 + "1", "1", "2"]])
def test_natural_order(spark, order):
    d = spark.createDataFrame([(x,) for x in reversed(order)], "s string")
    assert [r.s for r in d.orderBy(text.natural_key(F.col("s"))).collect()] == order


def test_clever_key(spark):
    d = spark.createDataFrame([("a10", "a9"), ("A2", "a2")], "a string, b string")
    got = d.select((text.clever_key(F.col("a")) < text.clever_key(F.col("b"))).alias("lt"), (text.clever_key(F.col("a")) == text.clever_key(F.col("b"))).alias("eq")).collect()
    assert [r.lt for r in got] == [False, False] and got[1].eq


def test_scalars(spark):
    d = spark.createDataFrame([("Éclair & Co. ’s ß", "One Piece - Chapter 1", "One Piece")], "a string, b string, c string")
    r = d.select(text.norm(F.col("a")).alias("n"), text.remove_prefix_ci(F.col("b"), F.lower("c")).alias("p"), codecs.crc16(F.lit("123456789")).alias("crc"), codecs.fnv1a(F.lit("a")).alias("fnv"), codecs.hmac_hex(F.lit("x"), "k").alias("h"), codecs.base64url(F.lit("??>")).alias("b"), text.placeholder_to_empty(F.lit(" - ")).alias("e"), codecs.decode_uri(F.lit("100%")).alias("u")).first()
    assert r.n == "eclair and co s ss" and r.p == "Chapter 1" and r.crc == 0x31C3 and r.fnv & 0xFFFFFFFFFFFFFFFF == 0xAF63DC4C8601EC8C and len(r.h) == 64 and r.b == "Pz8-" and r.e == "" and r.u is None


def test_clean_up(spark):
    assert clean.clean_text(" Caf&eacute; &amp;&nbsp;&euro;1 &copy\r\n x ") == "Café & ©1 €\\r\\n x"
    assert clean.clean_text("&Agrave; &agrave; &EGRAVE;") == "À À &EGRAVE;"
    assert clean.clean_text("［1］（2）&#8211;&GT;&quot") == '[1](2)->"'
    for raw, want in (("a(b(c)d)e", "b(c)d"), ("()", ""), ("no pair", "no pair"), ("(open", "(open")):
        assert clean.between(raw, "(", ")") == want
    for url, want in (("https://a.b/c/d", ("https://a.b", "/c/d")), ("a.b/c", ("https://a.b", "/c")), ("a.b", ("", "/a.b")), ("www.a.b", ("https://www.a.b", "")), ("/x/y", ("", "/x/y")), ("//a.b/x", ("https://a.b", "/x")), ("ftp://host", ("ftp://host", "")), ("host:80/x", ("https://host/x:80", "")), ("http://h.c:8080//x", ("http://h.c:8080", "/x")), ("", ("", "")), ("/", ("", "")), (None, ("", ""))):
        assert clean.split_url(url) == want, url
    d = spark.createDataFrame([("https://r.x/", "t/1"), ("https://r.x", "/t/1"), ("https://r.x", "http://o.y/2"), ("", "/t")], "root string, link string")
    c = F.col
    got = [tuple(r) for r in d.select(clean.absolute(c("root"), c("link")), clean.fill_host(c("root"), c("link")), F.array_join(clean.link_forms(c("root"), c("link")), " ")).collect()]
    assert got == [("https://r.x/t/1", "https://r.x/t/1", "t/1 https://r.x/t/1"), ("https://r.x/t/1", "https://r.x/t/1", "/t/1 https://r.x/t/1"), ("http://o.y/2", "http://o.y/2", "http://o.y/2"), ("/t", "/t", "/t")]
    u = spark.createDataFrame([(" ://a.b/é x",), ("http://a/%20 b",), ("",), ("a.b/c?d=e&f",)], "u string")
    assert [r.n for r in u.select(clean.normal_url(c("u")).alias("n")).collect()] == ["https://a.b/%C3%A9%20x", "http://a/%20 b", "", "https://a.b/c?d=e&f"]
    n = spark.createDataFrame([(["a"], 4), (["a", "b"], 7), ([], 0)], "n array<string>, i int")
    assert [r.l for r in n.select(clean.chapter_label(c("n"), c("i")).alias("l")).collect()] == ["a", "b (2/2)", ""]
    assert text.fts_phrases("Tiếng Việt") == [" tieng", " viet"]
    v = spark.createDataFrame([("Tiếng Việt",)], "t string").select(text.fts_text(c("t")).alias("f")).first()
    assert v.f == " tieng viet"


def test_names():
    put = names.put
    assert put(" (%AUTHOR%) x", "author", "") == " x"
    assert put("[%ARTIST%]%MANGA%", "artist", "A") == "[A]%MANGA%" and put("%MANGA%", "artist", "A") == "%MANGA%" and put("a (%AUTHOR% b", "author", "") == "a  b"
    for text_, want in (("Vol. 2 Ch. 7", "Vol. 02 Ch. 007"), ("Chapter 12.5", "Chapter 012.5"), ("xvol 3", "xvol 03"), ("a vol", "a vol"), ("revol 3", "revol 003"), ("Vol.1", "Vol.01"), ("Volume Not Available 4", "Volume Not Available 004")):
        assert names.padded(text_, 2, 3) == want, text_
    assert names.bare("a/b\x00 &amp; é", other="?") == "a_b_ & ?" and names.bare('a:b*"', delete='\\/:*?"<>|\t;') == "ab"
    v = dict.fromkeys(names.TOKENS, "")
    fix = names.bare
    assert names.renamed("%AUTHOR%", v | {"manga": "M/1"}, fix) == "M_1" and names.renamed("/%MANGA%...", v | {"manga": "M"}, fix) == "M"
    assert names.renamed("[%AUTHOR%]", v | {"chapter": "c", "numbering": "0007"}, fix) == "0007"


def test_fitted_names_count_utf16_units(spark):
    def plain(name, most):
        while len(name.encode("utf-16-le")) // 2 > most:
            name = name[1:]
        return name

    cases = ["abc", "a😀b", "😀😀😀", "é😀", "", "ab😀cd"]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    for most in (0, 1, 2, 3, 4, 9):
        assert [r.t for r in d.select("i", names.fitted(F.col("t"), most).alias("t")).orderBy("i").collect()] == [plain(c, most) for c in cases], most


def test_queue_upkeep(spark, tmp_path):
    for name, seq in (("a.jsonl.1", 1), ("a.jsonl", 2)):
        (tmp_path / name).write_text(f'{{"seq": {seq}, "level": "INFO"}}\n')
    assert [r.seq for r in io.log_files(spark, str(tmp_path)).collect()] == [1, 2]
    saved = io.backup(spark.range(3).toDF("i"), str(tmp_path / "b"))
    assert saved.count() == 3
    with pytest.raises(Exception, match="exist"):
        io.backup(spark.range(1).toDF("i"), str(tmp_path / "b"))


def test_pages_without_their_frame(spark):
    pages_ = [(1, "<title>T</title><p>one <b>two</b></p><a href=x>y</a>"), (2, "text <i>only</i>"), (3, "<head><title>T</title><div>d</div>")]
    n = pages.nodes(spark.createDataFrame(pages_, "page_id long, html string")).cache()
    names = {i: [r.name for r in n.where(f"kind = 'element' AND page_id = {i}").orderBy("id").collect()] for i in (1, 2, 3)}
    assert names == {1: ["html", "head", "title", "body", "p", "b", "a"], 2: ["html", "body", "i"], 3: ["html", "head", "title", "body", "div"]}
    body = pages.strings(n, pages.path(n, ("descendant", F.col("name") == "body"))).collect()
    assert {r.page_id: r.text for r in body} == {1: "one twoy", 2: "text only", 3: "d"}


def test_window_open(spark):
    d = spark.createDataFrame([(0,), (3600,), (80_000,)], "s int")
    got = d.select(queue.window_open(F.col("s"), 79_000, 1000).alias("wrap"), queue.window_open(F.col("s"), 5, 5).alias("always"), queue.window_open(F.col("s"), 3600, 3601).alias("one")).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, True, True), (True, True, False)]


PAGE = "<html><body><ul id=u class='y x'><li>One<li>two<br>2</ul><div class=x><a href='1'>A</a><p>t<a href='2'>B</a><p>u<img src=i></div><a href=3>C</a></body></html>"


def test_pages(spark):
    n = pages.nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).cache()
    a, any_element = F.col("name") == "a", F.col("kind") == "element"
    find = lambda *steps: [r.text for r in pages.strings(n, pages.path(n, *steps)).orderBy("page_id", "id").collect()]
    assert find(("descendant", F.col("name") == "li")) == ["One", "two2"]
    assert find(("descendant", pages.has_class("x") & (F.col("name") == "div")), ("child", a)) == ["A"]
    assert find(("descendant", pages.has_class("x")), ("descendant", a)) == ["A", "B"]
    assert find(("descendant", a & pages.attr("href").startswith("2"))) == ["B"]
    assert find(("descendant", a & (F.col("nth") == 1))) == ["A", "B"]
    assert find(("descendant", any_element & pages.nth_child(2, 1)), ("self", a)) == ["A", "B", "C"]
    for axis, want in (("parent", {"div", "p", "body"}), ("ancestor", {"div", "p", "body", "html"}), ("preceding-sibling", {"ul", "div"}), ("following-sibling", {"p"}), ("following", {"p", "a", "img"}), ("preceding", {"ul", "li", "br", "div", "a", "p", "img"})):
        assert {r.name for r in pages.step(n, pages.path(n, ("descendant", a)), axis, any_element).collect()} == want, axis
    assert n.where("page_id <> 1").count() == 0


def test_streams(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.key: r.n for r in stateful.run_to_end(events.source(spark, sf), lambda s: stateful.throttled(s, gap_ms=86_400_000)).groupBy("key").agg(F.count("*").alias("n")).collect()}
    want: dict = {}
    last: dict = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "unix_millis(cast(ts as timestamp)) AS at", "event_id").orderBy("at", "event_id").collect():
        if r.user_id not in last or r.at - last[r.user_id] >= 86_400_000:
            last[r.user_id] = r.at
            want[r.user_id] = want.get(r.user_id, 0) + 1
    assert got == want
    always = stateful.run_to_end(events.source(spark, sf), lambda s: stateful.throttled(s, gap_ms=86_400_000, last=F.col("event_id") % 7 == 0)).select("event_id").collect()
    assert {r.event_id for r in always} >= {r.event_id for r in spark.read.parquet(f"{sf}/events.parquet").where("event_id % 7 = 0").collect()}
    d = spark.createDataFrame([(0, 1.0), (2, 3.0), (3, None), (400, 5.0)], "s int, value double").select(F.timestamp_seconds("s").alias("second"), "value")
    got = [(int(r.second.timestamp()), r.value) for r in events.speed_history(d).collect()]
    assert len(got) == 300 and got[0] == (101, 0.0) and got[-1] == (400, 5.0)
    assert [(int(r.second.timestamp()), r.value) for r in events.speed_history(d.where("s < 9")).collect()] == [(0, 1.0), (1, 0.0), (2, 3.0), (3, 0.0)]
    assert events.speed_history(d.limit(0)).collect() == []
    named = events.source(spark, sf).select("event_id", "event_type")
    kinds = tuple(r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().collect())
    assert events.run(events.typed(named, "event_type", kinds)).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    with pytest.raises(Exception, match=f"no such event: {kinds[0]}"):
        events.run(events.typed(named, "event_type", kinds[1:]))


def test_small_operators(spark):
    d = spark.createDataFrame([(i,) for i in range(6)], "i int")
    got = {r.i: r.place for r in ordered.masked_move(d, "i", F.col("i") % 2 == 1, -F.col("i")).collect()}
    assert got == {0: 0, 2: 2, 4: 4, 5: 1, 3: 3, 1: 5}
    f = spark.createDataFrame([("a", 40, 3), ("b", 40, 2), ("c", 40, 1)], "path string, size long, s int").withColumn("used_at", F.timestamp_seconds("s"))
    assert [r.path for r in compare.evict(f, 80).collect()] == ["c"]
    t = spark.createDataFrame([(1, "2020-06-01 12:00:00")], "i int, s string").select(io.local_to_utc(F.col("s").cast("timestamp"), "Europe/Berlin").cast("string").alias("u"))
    assert t.first().u == "2020-06-01 10:00:00"
    # in the gap of spring and the overlap of autumn the offset before the change counts
    odd = spark.createDataFrame([(1, "2020-03-29 02:30:00"), (2, "2020-10-25 02:30:00"), (3, "2020-03-29 03:00:00"), (4, "2020-10-25 03:00:00")], "i int, s string").select("i", io.local_to_utc(F.col("s").cast("timestamp"), "Europe/Berlin").cast("string").alias("u"))
    assert [r.u for r in odd.orderBy("i").collect()] == ["2020-03-29 01:30:00", "2020-10-25 00:30:00", "2020-03-29 01:00:00", "2020-10-25 02:00:00"]
    m = spark.createDataFrame([(1, "cbz"), (1, "folder"), (2, "pdf"), (2, "pdf"), (2, "cbz")], "k int, format string")
    assert {r.k: r.format for r in library.majority_format(m, "k").collect()} == {1: "folder", 2: "pdf"}


def test_long_positions_keep_their_digits(spark):
    from folium.operators import library

    chapters = spark.createDataFrame([(1, 1234, "a"), (1, 12345, "a"), (1, 123456, "a"), (1, 7, "a")], "favorite_id long, position long, name string")
    files = spark.createDataFrame([(1, "12345 a"), (1, "0007 a")], "favorite_id long, file string")
    assert sorted(r.position for r in library.missing_files(chapters, files).collect()) == [1234, 123456]


def test_whole_tables_are_read(spark, tmp_path):
    import __spark_entry__ as entry

    orders = [(k, 1, "1-URGENT") for k in (1234, 12345, 99_998, 99_999)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    parts = [(k, f"n{k}", "STD", 10) for k in range(1, 401)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r.position for r in run("missing_artefacts")) == [1234, 99_998]
    assert len(run("natural_order")) == 400 == sum(r.n for r in run("resolve_decide"))
