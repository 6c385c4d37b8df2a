from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folium.functions.text import fitted_texts, title_key_texts
from folium.operators import catalog, compare, library, queue
from folium.sources import pages
from folium.sources.search_index import SearchIndex

LISTING = "module_id string, link string, title string, alttitles string, status string"


def test_cookies(spark):
    jar = [
        (1, "a", "dom", "b.c", False, "/", False, None),
        (2, "a", "host", "x.b.c", True, "/foo", False, None),
        (3, "b", "slash", "X.b.C", False, "/foo/", False, None),
        (4, "c", "gone", "b.c", False, "/", False, 100),
        (5, "d", "kept", "b.c", False, "/FOO", True, 101),
        (6, "e", "other", "c.d", False, "/", False, None),
        (7, "f", "none", "", False, "/", False, None),
        (8, "g", "part", "b.c", False, "/fo", False, None),
        (9, "h", "host only", "b.c", True, "/", False, None),
        (10, "i", "Case", "B.c", False, "/", False, None),
    ]
    cookies = spark.createDataFrame(jar, "place int, name string, value string, domain string, host_only boolean, path string, http_only boolean, expires long")
    urls = {1: "https://x.b.c/foo", 2: "https://X.B.C:8080/foo/bar?q", 3: "https://xb.c/", 4: "ftp://b.c/foo", 5: "http://b.c", 6: "nonsense", 7: "https://u@b.c/foobar", 8: None}
    got = compare.cookies_for(spark.createDataFrame(list(urls.items()), "request_id int, url string"), cookies, F.lit(100))
    found = {i: {} for i in urls}
    for r in got.collect():
        found[r.request_id][r.name] = r.value
    assert found[1] == {"a": "host", "d": "kept"}  # the path itself, in any case; not /fo, nor /foo/
    assert found[2] == {"a": "dom", "b": "slash"}  # below /foo/ only
    assert found[3] == found[6] == found[8] == {}
    assert found[4] == {"a": "dom", "h": "host only", "i": "Case"}  # http-only ones stay away
    assert found[5] == found[7] == {"a": "dom", "h": "host only", "i": "Case"}


def test_snapshots_that_are_not_whole_are_refused(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = lambda *rows: spark.createDataFrame([(*r, False) if len(r) == 2 else r for r in rows], "path string, hash string, truncated boolean")
    tried = iter(range(99))
    diff = lambda d, share=0.0: {tuple(r) for r in compare.trusted_diff(old, d, f"file://{tmp_path}/{next(tried)}", share).collect()}
    assert diff(new(("a", "1"), ("b", "x"), ("d", "4"))) == {("b", "changed"), ("c", "deleted"), ("d", "added")}
    assert diff(new(("a", "1"), ("a", "1")).drop("truncated")) == {("b", "deleted"), ("c", "deleted")}
    for rows, share, why in ((new().limit(0), 0, "empty"), (new(("a", "1"), ("b", "2", True)), 0, "truncated"), (new(("a", None)), 0, "lack"), (new(("a", "1"), ("a", "2")), 0, "several"), (new(("a", "1")), 0.5, "only 1")):
        with pytest.raises(compare.Refused, match=why):
            diff(rows, share)


def test_until_open(spark):
    d = spark.createDataFrame([(0,), (21_599,), (21_600,), (50_000,), (79_199,), (79_200,), (None,)], "s int")
    got = d.select(queue.until_open(F.col("s"), 79_200, 21_600).alias("night"), queue.until_open(F.col("s"), 21_600, 79_200).alias("day"), queue.until_open(F.col("s"), 7, 7).alias("always")).collect()
    assert [r.night for r in got] == [None, None, 57_600, 29_200, 1, None, None]
    assert [r.day for r in got] == [21_600, 1, None, None, None, 28_800, None]
    assert all(r.always is None for r in got)


def fitted(texts, limit):
    total = sum(map(len, texts))
    texts = list(texts)
    for i in range(len(texts) - 1, -1, -1):
        if total <= limit:
            break
        keep = max(len(texts[i]) - (total - limit), 1)
        cut = texts[i] if len(texts[i]) <= keep else texts[i][: keep - 1] + "…"
        total += len(cut) - len(texts[i])
        texts[i] = cut
    return texts


def test_fitted_texts(spark):
    cases = [["alpha", "", "gämma", "δ", "a long last text"], ["one"], [], ["x", "y", "z"], ["abc" * 9, "def"]]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t array<string>")
    for limit in (0, 1, 3, 7, 20, 99):
        assert [r.t for r in d.select("i", fitted_texts(F.col("t"), limit).alias("t")).orderBy("i").collect()] == [fitted(c, limit) for c in cases], limit


def test_sorts(spark):
    rows = [(0, "Task 10", "waiting", 2, 10, 5.0, "b", "/z", 3), (1, "task 9", "done", 10, 10, 50.0, "a2", "/a", 1), (2, "Task 9", "waiting", 2, 9, 5.0, "a10", "/a", 2)]
    d = spark.createDataFrame(rows, "place int, title string, status string, done int, total int, bytes_per_sec double, module_id string, save_to string, date_added int")
    order = lambda by, desc=False: [r.place for r in queue.sorted_tasks(d, by, desc).collect()]
    assert {by: order(by) for by in queue.TASK_SORTS} == {"queue": [0, 1, 2], "title": [2, 0, 1], "status": [1, 0, 2], "progress": [2, 0, 1], "speed": [0, 2, 1], "website": [1, 2, 0], "save_to": [1, 2, 0], "added": [1, 2, 0]}
    assert order("speed", True) == [1, 2, 0] and order("queue", True) == [2, 1, 0]
    f = spark.createDataFrame([(0, "Émile", 1, None, 5), (1, "emile", 3, 7, None), (2, "Abel", 3, 9, 5)], "sort_order int, display_title string, new_chapters int, last_updated int, date_added int")
    assert {by: [r.sort_order for r in library.sorted_favorites(f, by).collect()] for by in library.SORTS} == {"library": [0, 1, 2], "title": [2, 0, 1], "new": [1, 2, 0], "updated": [2, 1, 0], "added": [0, 2, 1]}
    for bad in (lambda: queue.sorted_tasks(d, "x"), lambda: library.sorted_favorites(f, "x")):
        with pytest.raises(ValueError):
            bad()


def test_picks(spark):
    series = spark.createDataFrame([(i, f"s{i}") for i in range(60)], "series long, title string")
    keys = spark.createDataFrame([("shadow star", 7), ("shadow", 9), ("shadows", 9), ("7 seeds", 30), ("7", 31)] + [(f"many {'x' * i}", i) for i in range(40)], "key string, series long")
    find = lambda q: [r.series for r in catalog.pick_search(series, keys, q, r"site\.org/(\d+)").collect()]
    assert find("see https://site.org/12 there") == [12] and find("https://site.org/999") == []
    assert find(" Shadow (colored)") == [] and find("(x) Shadow") == [] and find("SHADOW!") == [9, 7]
    assert find("7") == [7, 31, 30] and find("?!") == [] and find("999") == [] and find("manY") == list(range(20))
    assert title_key_texts("Shadow (colored)") == ["shadow colored", "shadow"] and title_key_texts("!") == []


PAGE = '<html lang="en"><body><div lang="DE"><p class="a b" data-x="Foo-bar baz">one</p><p>two</p><span>s</span><p>three</p></div><ul><li>1</li><li>2</li><li>3</li><li></li></ul><a name="n">x</a><a href="/y" checked>y</a></body></html>'


def test_selectors(spark):
    n = pages.nodes(spark.createDataFrame([(1, PAGE), (2, "<p>alone</p>")], "page_id int, html string"))
    name = lambda x: F.col("name") == x
    text = lambda d: [r.text for r in pages.strings(n, d).where("page_id = 1").orderBy("id").collect()]
    assert text(pages.select(n, name("p"), ("+", name("p")))) == ["two"] and text(pages.select(n, name("span"), ("+", name("p")))) == ["three"]
    assert text(pages.select(n, name("p"), ("~", name("p")))) == ["two", "three"] and text(pages.select(n, name("li"), ("~", F.lit(True)))) == ["2", "3", ""]
    assert text(pages.select(n, name("body"), (">", name("p")))) == [] and text(pages.select(n, name("div"), (">", name("span")))) == ["s"]
    assert text(pages.select(n, name("ul"), (" ", name("li") & pages.nth_child(2, 1, "nth_last")))) == ["2", ""]
    assert text(pages.select(n, name("p") & pages.nth_child(-1, 2, "nth_last_of_type"))) == ["two", "three"]
    assert text(pages.select(n, name("p") & pages.pseudo("first-of-type"))) == ["one"] and text(pages.select(n, name("p") & pages.pseudo("last-of-type"))) == ["three"]
    assert text(pages.select(n, name("span") & pages.pseudo("only-of-type"))) == ["s"] and text(pages.select(n, name("p") & pages.pseudo("only-of-type"))) == []
    assert text(pages.select(n, name("li") & pages.pseudo("empty"))) == [""] and [r.name for r in pages.select(n, pages.pseudo("root")).where("page_id = 1").collect()] == ["html"]
    assert text(pages.select(n, pages.pseudo("link"))) == ["y"] and text(pages.select(n, pages.pseudo("checked"))) == ["y"]
    for op, value, hit in (("", "", True), ("=", "foo-BAR baz", True), ("=", "foo", False), ("^=", "FOO", True), ("$=", "Baz", True), ("*=", "o-b", True), ("~=", "baz", True), ("~=", "foo", False), ("|=", "foo", True), ("|=", "bar", False)):
        assert bool(text(pages.select(n, name("p") & pages.attr_test("data-x", op, value)))) == hit, (op, value)
    assert text(pages.in_language(n, "de").where(name("p"))) == ["one", "two", "three"] and text(pages.in_language(n, "en").where(name("li"))) == ["1", "2", "3", ""]
    assert text(pages.without(pages.select(n, name("p")), pages.select(n, name("div"), (">", name("p") & pages.has_class("a"))))) == ["two", "three"]
    with pytest.raises(ValueError):
        pages.select(n, name("p"), ("|", name("p")))


def listing(spark, rows):
    return spark.createDataFrame(rows, LISTING)


TITLES = [("m", "/1", "Dragon Pie", "Le Pâté; Drago", "1"), ("m", "/2", "dragonfly dragon", None, "0"), ("n", "/1", "The Pie", "Ünder-dragon x", "1"), ("n", "/3", None, None, "1"), ("o", "/9", "12 dragons", "", "1")]


@pytest.mark.parametrize("small", [True, False])
def test_index_equals_the_scan(spark, tmp_path, monkeypatch, small):
    if not small:
        monkeypatch.setattr("folium.sources.search_index.SMALL", 0)
        monkeypatch.setattr("folium.sources.search_index.FILE_ROWS", 2)
    rows = listing(spark, TITLES)
    index = SearchIndex(spark, f"file://{tmp_path}/index", rows)
    assert index.search("dragon").collect() == []
    index.replace(rows)

    def same(rows, *modules):
        for q in ("dragon", "dra pie", '"Pie', "under-dragon", "pate", "12", "d", "", "?!", "dragon x", "pie dragon", "zzz", "le pâ"):
            want = catalog.where(rows, q, modules=list(modules) or None)
            assert sorted(map(str, index.search(q, list(modules) or None).collect())) == sorted(map(str, want.collect())), q

    same(rows)
    same(rows, "n", "o")
    later = listing(spark, [("m", "/1", "New Dragon", "", "2"), ("p", "/5", "Fifth pie", "", "1")])
    SearchIndex(spark, index.root, rows).replace(later, ["m", "o"])  # another writer; o has no rows left
    index.refresh()
    same(rows.where("module_id = 'n'").unionByName(later))
    assert set(index.parts) == {"m", "n", "p"}
    plan = index.search("dragon", ["m"])._jdf.queryExecution().toString()
    scan = next(line for line in plan.split("== Physical Plan ==")[1].splitlines() if "PartitionFilters" in line)
    assert "part#" in scan.split("PartitionFilters")[1] and "StringStartsWith(token,dragon)" in scan


def test_a_replacement_that_died_is_not_seen(spark, tmp_path):
    rows = listing(spark, TITLES)
    index = SearchIndex(spark, f"file://{tmp_path}/index", rows)
    index.replace(rows)
    rows.withColumn("_texts", F.array(F.lit(" dragon"))).withColumn("token", F.lit("dragon")).withColumn("part", F.lit("m@half")).withColumn("prefix", F.lit("~")).write.mode("append").partitionBy("part", "prefix").parquet(f"{index.root}/tokens")
    index.refresh()
    assert index.search("dragon").count() == 4


def test_features_and_differences(spark):
    rows = [("//a", False, "path"), ("//a/text()", False, "path"), ("'count(' = string(//a)", False, "string()"), ('concat("x(", count(b))', False, "concat()"), ("$o?k", False, "json"), ("jn:keys(.)", False, "json"), ("a > b", True, "css selector"), ("node()[fn:not(x)]", None, "fn:not()")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "entry int, e string, css boolean, want string")
    assert all(r.want == r.f for r in d.select("want", compare.feature_of(F.col("e"), F.col("css")).alias("f")).collect())
    left = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", None), (4, "b", "y")], "entry int, feature string, value string")
    right = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "n")], "entry int, value string")
    assert {tuple(r) for r in compare.differences(left, right, "entry", "feature").collect()} == {("a", 2, 1), ("b", 2, 1)}


def test_grouped_modules(spark):
    rows = [(1, "Zeta", "Raw", "https://z.org"), (2, "alpha", "English", "https://B.org/x"), (3, "Alpha", "english", "https://a.org"), (4, "alpha", "English", "https://a.org:80"), (5, "Ähnlich", None, None), (6, "b", "", "nothing")]
    d = spark.createDataFrame(rows, "module_id int, name string, category string, root_url string")
    got = [(r.category, r.label) for r in library.grouped_modules(d).orderBy("place").collect()]
    assert got == [("English", "alpha (a.org)"), ("English", "alpha (b.org)"), ("english", "Alpha"), ("Other", "Ähnlich"), ("Other", "b"), ("Raw", "Zeta")]
