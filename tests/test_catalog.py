from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folium.operators import catalog
from folium.sources import io
from folium.sources.search_index import SearchIndex

ROWS = [("m", "/1", "One Piece", "", "Action, Adventure, Comedy"), ("m", "/2", "Wan Pisu", "One Piece; ワンピース", "Action, Adventure"), ("m", "/3", "Naruto", "", "Action, Romance"), ("m", "/4", "Piece of Cake", "", "Comedy, Romance")]


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.createDataFrame(ROWS, "module_id string, link string, title string, alttitles string, genres string")
    return d.withColumn("status", F.lit("1")).withColumn("series_id", F.when(F.col("link") == "/1", 5)).withColumn("format", F.lit("manga"))


@pytest.mark.parametrize(
    "filters,links",
    [
        ({"query": "one piece"}, ["/1", "/2"]),
        ({"query": "ワンピース"}, ["/2"]),
        ({}, ["/3", "/1", "/4", "/2"]),
        ({"query": "one pi"}, ["/1", "/2"]),
        ({"query": "naru"}, ["/3"]),
        ({"query": '"one" AND -piece* NEAR('}, []),
        ({"query": '"'}, ["/3", "/1", "/4", "/2"]),
        ({"query": "one-pi"}, ["/1", "/2"]),
        ({"include": ("action", "adventure")}, ["/1", "/2"]),
        ({"exclude": ("Comedy",)}, ["/3", "/2"]),
        ({"include": ("Romance",), "exclude": ("Comedy",)}, ["/3"]),
        ({"query": "piece", "exclude": ("Comedy",)}, ["/2"]),
        ({"include": ("%",)}, []),
        ({"format": "unknown"}, ["/3", "/4", "/2"]),
        ({"format": "manga", "modules": ["m"], "status": "1"}, ["/1"]),
    ],
)
def test_search(rows, filters, links):
    assert [r.link for r in catalog.page(catalog.where(rows, **filters), 0, 50, "link").collect()] == links


def test_pages(rows):
    want = ["Naruto", "One Piece", "Piece of Cake", "Wan Pisu"]
    assert [r.title for n in (0, 3) for r in catalog.page(rows, n, 3, "title").collect()] == want
    assert [r.title for r in catalog.page_after(rows, "One Piece", "m", "/1", 9, "title").collect()] == want[2:]


def test_facets(rows):
    got = {(r.facet, r.value): r.n for r in catalog.facets(rows).collect()}
    assert got[("genre", "Action")] == 3 and got[("genre", "Romance")] == 2 and got[("format", "unknown")] == 3 and got[("module", "m")] == 4


def test_index_agrees_with_the_predicate(spark, rows, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index", rows)
    index.replace(rows)
    for q in ("one piece", "naru", "pi", "zzz", "ワン", "one-pi", "piece-one", ""):
        got = sorted(r.link for r in index.search(q).collect())
        assert got == sorted(r.link for r in catalog.where(rows, query=q).collect())


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, "x", 0), ("a", 1, "y", 1), ("b", 2, "z", 2)], "p string, k int, v string, o int")
    path = str(tmp_path / "t")
    io.replace_partition(d, path, "p", ["k"], "o")
    io.replace_partition(spark.createDataFrame([("a", 9, "n", 0)], d.schema), path, "p", ["k"], "o")
    assert {(r.p, r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9, "n"), ("b", 2, "z")}
    root = str(tmp_path / "swap")
    io.swap(d, root, "one")
    io.swap(d.limit(1), root, "two")
    assert io.current(spark, root).count() == 1 and spark.read.parquet(f"{root}/one").count() == 3
    with pytest.raises(ValueError):
        io.not_empty(d.limit(0), "active series")
    stamps = spark.createDataFrame([("2020-01-02",), ("2020-01-02 03:04:05",), ("x",)], "s string").select(io.any_timestamp(F.col("s")).isNotNull().alias("ok"))
    assert [r.ok for r in stamps.collect()] == [True, True, False]
