"""The library's relations, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as there are cores where the source gives fewer: a file of one row group is one task.
    Larger sources have more tasks than cores and are read as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows: one per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("module_id"),
        F.col("p_partkey").alias("link"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("alttitles"),
        F.concat_ws(", ", "p_type", "p_brand").alias("genres"),
        (F.col("p_size") % 4).cast("string").alias("status"),
        F.col("p_size").alias("numchapter"),
    )


LISTING_SQL = "(SELECT p_brand module_id, p_partkey link, p_name title, p_type alttitles, p_type || ', ' || p_brand genres, (p_size % 4)::VARCHAR status, p_size numchapter FROM part)"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per part, its least supplier, for four parts of five; not accepted where the supplier's balance is low."""
    lines = table(spark, sf_dir, "lineitem").where("l_partkey % 5 <> 0").groupBy(F.col("l_partkey").alias("link")).agg(F.min("l_suppkey").alias("s_suppkey"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("module_id"), F.col("p_partkey").alias("link"))
    confidence = F.when(F.col("s_acctbal") >= 2000, "title+author").otherwise("ambiguous")
    return lines.join(sup, "s_suppkey").join(own, "link").select("module_id", "link", F.col("s_suppkey").alias("series_id"), confidence.alias("confidence"), (F.col("s_nationkey") % 5).cast("string").alias("format"))


#: As :func:`matches`, with the series of accepted matches alone.
MATCHES_SQL = "(SELECT p_brand module_id, link, CASE WHEN s_acctbal >= 2000 THEN s_suppkey END series_id, (s_nationkey % 5)::VARCHAR format FROM (SELECT l_partkey link, min(l_suppkey) s_suppkey FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1) JOIN supplier USING (s_suppkey) JOIN part ON p_partkey = link)"
