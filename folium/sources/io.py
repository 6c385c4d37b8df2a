"""Readers of older forms, and writers: replace a partition, upsert, insert absent, swap, back up."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.ordered import keep_one


def replace_partition(rows: DataFrame, path: str, partition: str, keys: list[str], order: str) -> None:
    """Replace the partitions that ``rows`` hold; of rows with one key the first in order stays."""
    first = keep_one(rows, [F.col(k) for k in [partition, *keys]], [F.col(order)])
    first.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, each key once."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def swap(rows: DataFrame, root: str, build: str) -> str:
    """Write a new build beside the old ones, then point to it; readers of the old build keep it.

    Pointers are only ever added, the newest one counts, so there is no moment without one.
    """
    path = f"{root}/{build}"
    rows.write.mode("overwrite").parquet(path)
    spark = rows.sparkSession
    spark.createDataFrame([(build, time.time_ns())], "build string, at long").coalesce(1).write.mode("append").json(f"{root}/_pointer")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    newest = spark.read.schema("build string, at long").json(f"{root}/_pointer").orderBy(F.desc("at")).first()
    return spark.read.parquet(f"{root}/{newest['build']}")


def backup(rows: DataFrame, path: str) -> DataFrame:
    """A whole copy at a place where there is none yet, read back."""
    rows.write.mode("error").parquet(path)
    return rows.sparkSession.read.parquet(path)


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all log files of a folder, rotated ones too, the oldest first."""
    schema = "seq long, time string, level string, target string, module string, message string"
    return spark.read.schema(schema).json(f"{folder}/*.jsonl*").orderBy("seq")


def not_empty(rows: DataFrame, what: str) -> DataFrame:
    """The rows, or an error if there are none."""
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows


def typed(rows: DataFrame, **kinds: str) -> DataFrame:
    """Foreign columns by affinity: what does not cast becomes '' or 0, and so does null."""
    return rows.select(*[F.coalesce(F.col(c).try_cast(k), F.lit("" if k == "string" else 0).cast(k)).alias(c) for c, k in kinds.items()])


def exploded_lines(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Newline-joined columns side by side as rows with their position; shorter ones give ''."""
    arrays = F.arrays_zip(*[F.split(F.coalesce(F.col(c), F.lit("")), "\r?\n").alias(c) for c in columns])
    d = rows.select(*keys, F.posexplode(arrays).alias("position", "_z"))
    return d.select(*keys, "position", *[F.coalesce(F.col("_z")[c], F.lit("")).alias(c) for c in columns])


def any_timestamp(c: Column) -> Column:
    """The first of several date forms that fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")])


def local_to_utc(c: Column, zone: str) -> Column:
    """Wall clock to UTC; in a gap or overlap the zone's offset before the change counts."""
    return F.to_utc_timestamp(c, zone)


#: Prefixes that every task may hold.
FEW = 10_000


def longest_prefix(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each row with the longest entry of ``prefixes`` that its column starts with.

    A value's beginnings at the lengths that occur are looked up one length at a time, so joins are by equality, and where
    the prefixes are few, rows are not moved for it.
    """
    prefixes = prefixes.dropDuplicates([prefix])
    lengths = sorted(map(tuple, prefixes.where(F.col(prefix).isNotNull()).groupBy(F.length(prefix)).count().collect()))  # as many as there are lengths
    few = sum(n for _, n in lengths) <= FEW
    d = rows
    for n, _ in lengths:
        own = prefixes.where(F.length(prefix) == n).select(F.col(prefix).alias(f"_p{n}"), F.struct(*prefixes.columns).alias(f"_b{n}"))
        begins = F.when(F.length(column) >= n, F.substring(column, 1, n))
        d = d.join(F.broadcast(own) if few else own, begins == F.col(f"_p{n}"), "left").drop(f"_p{n}")
    best = F.coalesce(*[f"_b{n}" for n, _ in reversed(lengths)], F.lit(None).cast(prefixes.schema.simpleString()))
    return d.withColumn("_b", best).select(*rows.columns, "_b.*")
