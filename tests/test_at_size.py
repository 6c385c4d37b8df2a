"""Queries over tables with hot keys, and steps that must not grow with a task's rows."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folium.plans import import_queries, upkeep_queries
from folium.sources import io, pages


def _written(frames: dict, folder) -> str:
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_cross_ids_of_a_hot_id(spark, tmp_path):
    """60,000 links and 60,000 series under one id: they were 3.6 billion pairs."""
    n = spark.range(60_000)
    sf = _written({"customer": n.select((F.col("id") * 40).alias("c_custkey"), F.lit(0).alias("c_nationkey")), "supplier": n.select((F.col("id") * 60).alias("s_suppkey"))}, tmp_path)
    got = entry.queries()["cross_ids"](spark, sf).agg(F.count("*"), F.min("n_series"), F.max("n_series"), F.max("first_series")).first()
    assert tuple(got) == (60_000, 60_000, 60_000, 0)


CUT = '<html lang="fr"><head><meta charset="utf-8"><title>a&amp;b &amp &am &quot;c&quot</title></head><body><nav><ul><li><a href="/x?a=1&amp;b=2">l&amp;1</a></li><li><a href="/&quot;y">l&quot;2</a></li></ul></nav><div class="ad">x</div><article><h1>a&amp;b &amp &quot;c</h1></article></body></html>'


@pytest.mark.parametrize("name", ["page_titles", "page_selectors", "page_links"])
def test_pages_with_cut_escapes(spark, tmp_path, name):
    """Escapes that were cut short, and entities that the SQL leaves, stay as they are."""
    sf = _written({"pages": spark.createDataFrame([(1, "http://a.b/", CUT), (2, "http://a.b/", CUT.replace("&quot", "\ufdd0"))], "page_id long, url string, html string")}, tmp_path)
    got, duck = entry.queries()[name](spark, sf), duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_all_entities_by_default():
    rows = pages.page_rows(CUT)
    assert next(r["value"] for r in rows if r["kind"] == "text") == 'a&b & &am "c"'


def test_nodes_leave_in_parts(spark, monkeypatch):
    """The nodes of a task's pages were one batch, and as dicts all in memory."""
    made = []
    monkeypatch.setattr(pages, "page_rows", lambda html, entities=None, real=pages.page_rows: (made.append(1), real(html, entities))[1])
    batch = pages.pa.RecordBatch.from_pydict({"key": list(range(4_000)), "html": ["<p>a<b>c</b></p>"] * 4_000})

    class Frame:
        schema = spark.createDataFrame([], "page_id long, html string").schema
        select = lambda self, *c: self
        withColumnRenamed = lambda self, *c: self.out

        def mapInArrow(self, task, schema):
            self.out = task(iter([batch]))
            return self

    out = pages.nodes(Frame())
    first = next(out)
    assert first.num_rows <= pages.NODES and len(made) < 2_000
    assert first.num_rows + sum(b.num_rows for b in out) == 6 * 4_000 and len(made) == 4_000


def test_cookies_of_a_hot_domain(spark, tmp_path):
    """100,000 pages and as many cookies of one domain: most were joined with all."""
    n = F.col("id")
    site = F.when(n % 2 == 0, "https://a.example.net/").otherwise("http://b.example.net/fr/")
    sf = _written({"pages": spark.range(100_000).select(n.alias("page_id"), F.concat(site, (n % 7).cast("string")).alias("url"))}, tmp_path)
    got = entry.queries()["cookie_selection"](spark, sf)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet/*.parquet' WHERE page_id % 210 < 42 OR page_id > 99000")
    some = spark.read.parquet(f"{sf}/pages.parquet").where("page_id % 210 < 42 OR page_id > 99000")
    small = _written({"pages": some}, tmp_path / "some")
    want = duck.sql(f"SELECT request_id, name, value FROM ({entry.oracle_sql()['cookie_selection']})").fetchall()
    assert sorted(map(tuple, entry.queries()["cookie_selection"](spark, small).collect())) == sorted(want)
    assert got.select("request_id").distinct().count() > 10_000


@pytest.mark.parametrize("name", ["entity_cleanup", "renamed_files", "cleaned_series"])
def test_python_steps_use_all_cores(spark, name):
    """The parts are one small file, which was one task, for the Python in it too."""
    plans = []
    real = upkeep_queries.spread
    for module in (upkeep_queries, import_queries):
        module.spread = lambda rows: (plans.append(real(rows)), plans[-1])[1]
    try:
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    finally:
        for module in (upkeep_queries, import_queries):
            module.spread = real
    assert plans and all(p.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism for p in plans)


def test_longest_prefix_moves_no_rows(spark):
    """Rows were shuffled twice by the column, whole, for a handful of prefixes."""
    rows = spark.createDataFrame([(1, "D:\\comics\\a"), (2, "D:\\b"), (3, "/else"), (4, None), (5, "D:\\b")], "place long, c string")
    paths = spark.createDataFrame([("D:\\", "/mnt/"), ("D:\\comics\\", "/library/")], "prefix string, target string")
    found = io.longest_prefix(rows, "c", paths, "prefix")
    assert {r.place: r.target for r in found.collect()} == {1: "/library/", 2: "/mnt/", 3: None, 4: None, 5: "/mnt/"}
    assert "hashpartitioning(c#" not in found._jdf.queryExecution().toString()
    assert {r.target for r in io.longest_prefix(rows, "c", paths.limit(0), "prefix").collect()} == {None}
