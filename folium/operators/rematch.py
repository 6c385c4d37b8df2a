"""Matching again only what changed: a log of match runs, hand-picked series first, then what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import resolve
from folium.sources.keyed_log import KeyedLog

KEY = ["module_id", "link"]
#: What matching reads of a title, besides the catalog's build.
READ = ["title", "alttitles", "authors", "artists"]
MATCH = ["series_id", "confidence", "format", "publication", "year", "fingerprint"]


def match_log(spark: SparkSession, root: str, listing: DataFrame) -> KeyedLog:
    """The stored matches of titles like those of ``listing``."""
    kind = {f.name: f.dataType.simpleString() for f in listing.schema.fields}
    schema = f"module_id {kind['module_id']}, link {kind['link']}, series_id long, confidence string, format string, publication string, year int, fingerprint string, run long"
    return KeyedLog(spark, root, schema, KEY)


def fingerprint(build: str) -> Column:
    """What a title was matched on, and against which build of the catalog."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in READ], F.lit(build)))


def due(listing: DataFrame, favorites: DataFrame, stored: DataFrame, picked: DataFrame, build: str, everything: bool = False) -> DataFrame:
    """The titles to match, with their fingerprint: listed ones and favorites that no list has, unless picked by hand;
    only those that are unmatched, changed, or matched against another build, unless ``everything`` is."""
    other = favorites.join(listing.select(*KEY), KEY, "left_anti")
    rows = listing.select(*KEY, *READ).unionByName(other.select(*KEY, *READ)).withColumn("fingerprint", fingerprint(build))
    rows = rows.join(picked.select(*KEY), KEY, "left_anti")
    if everything:
        return rows
    known = stored.select(*KEY, F.col("fingerprint").alias("_known"))
    return rows.join(known, KEY, "left").where(~F.col("fingerprint").eqNullSafe(F.col("_known"))).drop("_known")


def hand_picked(picked: DataFrame, series: DataFrame) -> DataFrame:
    """Matches of the picks ``(module_id, link, series_id)``; a pick whose series the catalog has no more is ``gone``, and
    counts again with a build that has it."""
    there = series.select(F.col("series").alias("_s"))
    rows = picked.join(there, picked["series_id"] == F.col("_s"), "left")
    rows = rows.select(*KEY, F.col("_s").alias("series_id"), F.lit("manual").alias("confidence"), F.lit("").alias("fingerprint"), F.col("_s").isNull().alias("gone"))
    return resolve.described(rows, series)


def rematch(log: KeyedLog, run: int, listing: DataFrame, favorites: DataFrame, picked: DataFrame, catalog: dict[str, DataFrame], build: str, everything: bool = False, most: int = resolve.MOST, xids: DataFrame | None = None) -> DataFrame:
    """One run: matches of links that neither a list, nor a favorite, nor a pick has go; picks are stored; what is due is
    decided and stored. Returns what the run changed.

    ``catalog`` has ``titles`` and ``series`` (with type, status, year), ``links`` and ``xids`` if there are any. ``xids
    (module_id, link, ids, answered)`` are ids on other sites; a title whose question was not answered is matched
    without and stored as changed, so that the next run asks again. Tables are joined by key; none of the titles that
    are not due goes further than that.
    """
    if log.counts(run):
        return log.changed(run)
    stored, series = log.current(), catalog["series"]
    kept = favorites.select(*KEY).unionByName(picked.select(*KEY)).unionByName(listing.select(*KEY)).distinct()
    pruned = stored.join(kept, KEY, "left_anti").withColumn("gone", F.lit(True))

    picks = hand_picked(picked, series)
    old = stored.select(*KEY, F.struct("series_id", "confidence", "format", "publication", "year").alias("_old"))
    picks = picks.join(old, KEY, "left")
    same = F.col("_old").eqNullSafe(F.struct("series_id", "confidence", "format", "publication", "year"))
    picks = picks.where(F.when(F.col("gone"), F.col("_old").isNotNull()).otherwise(~same)).drop("_old")

    rows = due(listing, favorites, stored, picked, build, everything)
    if xids is not None:
        rows = rows.join(xids.select(*KEY, "ids", "answered"), KEY, "left")
        rows = rows.withColumn("fingerprint", F.when(~F.coalesce("answered", F.lit(True)), "").otherwise(F.col("fingerprint")))
    key = F.struct(*KEY).alias("link")
    inputs = resolve.match_inputs(rows.select(key, *READ))
    if xids is not None:
        inputs = inputs.join(rows.select(key, F.coalesce("ids", F.array().cast("array<string>")).alias("xids")), "link")
    if "links" in catalog:
        inputs = inputs.join(rows.select(key, F.col("link").cast("string").alias("link_key")), "link")
    decided = resolve.decide(inputs, catalog["titles"], series, most, catalog.get("links"), catalog.get("xids") if xids is not None else None)
    decided = resolve.described(decided, series).select("link.*", *MATCH[:-1]).join(rows.select(*KEY, "fingerprint"), KEY)

    # nothing the log cannot take back: the run is written whole, then counted
    changes = decided.withColumn("gone", F.lit(False)).unionByName(picks).unionByName(pruned.select(*KEY, *MATCH, "gone"))
    log.commit(changes.withColumn("year", F.col("year").cast("int")).withColumn("run", F.lit(run).cast("long")), run)
    return log.changed(run)
