from __future__ import annotations

from pyspark.sql import functions as F

from folium.operators import rematch, resolve

LISTED = "module_id string, link string, title string, alttitles string, authors string, artists string"
AZURE, NIGHT, GIRL = ("m", "/azure", "Azure", "", "Ann Writer", ""), ("m", "/night", "Night Sun", "", "", "Bo Painter"), ("m", "/girl", "The Girl", None, "Cy Inker", "")


def catalog(spark, *more, without=()):
    rows = [(2001, "Night Sun", "Yorunohi", "Bo Painter", "manga", "completed", 1998), (7001, "Azure", None, "Ann Writer", "manga", "completed", 1997), (741, "The Girl", None, "Cy Inker", "manhwa", "releasing", 2019), *more]
    d = spark.createDataFrame([r for r in rows if r[0] not in without], "series long, title string, other string, authors string, type string, status string, year int")
    keys = d.select("series", "type", "status", "year", resolve.title_keys(F.col("title")).alias("main_keys"), resolve.person_keys(F.col("authors")).alias("people"), resolve.title_keys(F.col("other")).alias("more"))
    return {"series": keys.drop("more"), "titles": keys.select(F.explode(F.concat("main_keys", "more")).alias("key"), "series")}


def run(spark, log, n, listed, cat, build="b1", favorites=(), picked=(), **more):
    tables = spark.createDataFrame(list(listed), LISTED), spark.createDataFrame(list(favorites), LISTED), spark.createDataFrame(list(picked), "module_id string, link string, series_id long")
    changed = rematch.rematch(log, n, *tables, cat, build, **more)
    return sorted((r.link, r.gone, r.confidence if not r.gone else "") for r in changed.collect())


def table(log):
    return {r.link: (r.confidence, r.series_id, r.format, r.publication, r.year) for r in log.current().collect()}


def log_of(spark, tmp_path):
    return rematch.match_log(spark, f"file://{tmp_path}/log", spark.createDataFrame([], LISTED))


def test_only_what_changed(spark, tmp_path):
    log, cat = log_of(spark, tmp_path), catalog(spark)
    assert log.current().count() == 0
    assert run(spark, log, 1, [NIGHT, GIRL], cat) == [("/girl", False, "title+author"), ("/night", False, "title+author")]
    assert run(spark, log, 2, [NIGHT, GIRL], cat) == []  # nothing changed
    night = (*NIGHT[:2], "Yorunohi", *NIGHT[3:])
    assert run(spark, log, 3, [night, GIRL, AZURE], cat) == [("/azure", False, "title+author"), ("/night", False, "title+author")]
    assert table(log) == {"/azure": ("title+author", 7001, "manga", "completed", 1997), "/night": ("title+author", 2001, "manga", "completed", 1998), "/girl": ("title+author", 741, "manhwa", "ongoing", 2019)}
    assert len(run(spark, log, 4, [night, GIRL, AZURE], cat, everything=True)) == 3
    assert len(run(spark, log, 5, [night, GIRL, AZURE], cat, build="b2")) == 3 and run(spark, log, 6, [night, GIRL, AZURE], cat, build="b2") == []
    before = table(log)
    assert log.compact(7) and table(log) == before and log.runs()[-1] == (7, True)
    assert run(spark, log, 8, [night, GIRL, AZURE], cat, build="b2") == []
    assert len(run(spark, log, 5, [AZURE], cat)) == 3 and table(log) == before  # a run that counts is not run again


def test_favorites_are_matched_and_kept(spark, tmp_path):
    log, cat = log_of(spark, tmp_path), catalog(spark)
    run(spark, log, 1, [NIGHT, AZURE], cat, favorites=[AZURE, GIRL])
    assert set(table(log)) == {"/night", "/azure", "/girl"}
    assert run(spark, log, 2, [NIGHT], cat, favorites=[AZURE, GIRL]) == []  # no longer listed, but a favorite
    assert run(spark, log, 3, [], cat, favorites=[GIRL]) == [("/azure", True, ""), ("/night", True, "")]
    assert set(table(log)) == {"/girl"}


def test_picks_come_first(spark, tmp_path):
    log, cat = log_of(spark, tmp_path), catalog(spark)
    pick = [("m", "/night", 7001), ("m", "/never", 741), ("m", "/lost", 1)]
    run(spark, log, 1, [NIGHT], cat, picked=pick)
    assert table(log) == {"/night": ("manual", 7001, "manga", "completed", 1997), "/never": ("manual", 741, "manhwa", "ongoing", 2019)}
    assert run(spark, log, 2, [NIGHT], cat, build="b2", picked=pick) == []
    assert run(spark, log, 3, [NIGHT], catalog(spark, without=[7001]), build="b3", picked=pick) == [("/night", True, "")]  # its series went
    assert run(spark, log, 4, [NIGHT], catalog(spark, without=[7001]), build="b3", picked=pick) == []
    assert run(spark, log, 5, [NIGHT], cat, build="b4", picked=pick) == [("/night", False, "manual")]  # and is back
    assert run(spark, log, 6, [NIGHT], cat, build="b4", picked=pick[1:]) == [("/night", False, "title+author")]  # no longer picked


def test_unanswered_ids_are_asked_again(spark, tmp_path):
    log, cat = log_of(spark, tmp_path), catalog(spark)
    cat["xids"] = spark.createDataFrame([("al:1", 741)], "key string, series long")
    ids = lambda known, ok: spark.createDataFrame([("m", "/night", known, ok)], "module_id string, link string, ids array<string>, answered boolean")
    run(spark, log, 1, [NIGHT], cat, xids=ids([], False))
    assert table(log)["/night"][:2] == ("title+author", 2001)
    assert run(spark, log, 2, [NIGHT], cat, xids=ids(["al:1"], True)) == [("/night", False, "cross-id")]
    assert run(spark, log, 3, [NIGHT], cat, xids=ids(["al:1"], True)) == []


def test_a_run_that_died_half_way_does_not_count(spark, tmp_path):
    log, cat = log_of(spark, tmp_path), catalog(spark)
    run(spark, log, 1, [NIGHT], cat)
    log.current().withColumn("gone", F.lit(True)).withColumn("run", F.lit(2).cast("long")).write.parquet(f"{log.root}/run-2")  # written, not counted
    assert set(table(log)) == {"/night"}
    assert run(spark, log, 2, [NIGHT, AZURE], cat) == [("/azure", False, "title+author")] and set(table(log)) == {"/night", "/azure"}


def test_hot_keys_are_settled_by_their_counts(spark):
    n = 3_000
    series = spark.range(n).select(F.col("id").alias("series"), F.array(F.lit("love")).alias("main_keys"), F.array(F.concat(F.lit("writer"), "id")).alias("people"), F.lit(None).cast("string").alias("type"))
    titles = series.select(F.explode("main_keys").alias("key"), "series").unionByName(series.where("series < 3").select(F.lit("few").alias("key"), "series"))
    inputs = spark.range(n).select(F.col("id").alias("link"), F.array(F.lit("love")).alias("keys"), F.array(F.lit("writer1")).alias("people"))
    blocks = resolve.title_blocks(titles)
    assert {(r.key, r.n, r.block is None) for r in blocks.collect()} == {("love", n, True), ("few", 3, False)}
    assert [tuple(r) for r in resolve.decide(inputs, titles, series).groupBy("confidence").count().collect()] == [("ambiguous", n)]
    keys = titles.where("key = 'love'")
    only = resolve.decide(inputs.withColumn("link_key", F.lit("love")), titles, series, links=keys)
    assert {r.confidence for r in only.select("confidence").distinct().collect()} == {"ambiguous"}


def test_any_main_key_narrows(spark):
    rows = [(1, ["shadow star extra", "shadow star"], ["a"]), (2, ["other"], ["a"])]
    series = spark.createDataFrame(rows, "series long, main_keys array<string>, people array<string>").withColumn("type", F.lit(None).cast("string"))
    titles = spark.createDataFrame([("shadow star", 1), ("shadow star", 2)], "key string, series long")
    inputs = spark.createDataFrame([("x", ["shadow star"], [])], "link string, keys array<string>, people array<string>")
    assert [(r.confidence, r.series_id) for r in resolve.decide(inputs, titles, series).collect()] == [("title-unique", 1)]


def test_report(spark):
    d = spark.createDataFrame([("link",), ("none",), ("link",), ("manual",)], "confidence string")
    assert {tuple(r) for r in resolve.match_report(d).collect()} == {("link", 2, 2), ("none", 1, 0), ("manual", 1, 1), ("all", 4, 3)}
