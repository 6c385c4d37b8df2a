"""Event streams: merge, resume without repeats, speed history. Those with keyed state are in ``stateful``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.shared import scratch


def source(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events as a stream, with a timestamp that carries a watermark. The files that are there come at once unless
    ``files_per_trigger`` says otherwise: a table's files are in no order of time, and a later batch's events would be late."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    d = reader.parquet(f"{sf_dir}/events.parquet*")  # a file or a folder of files
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame) -> DataFrame:
    """Everything the stream has so far, through a file sink, as a table."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def merged(streams: dict[str, DataFrame]) -> DataFrame:
    """Several streams as one, each row with its stream's name."""
    out = None
    for name, s in streams.items():
        one = s.withColumn("stream", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def resumed(stream: DataFrame, last: int, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Events after ``last``, each id once however often it is replayed within ``delay``; what comes later than that is
    dropped, new or not, as for any watermark."""
    return stream.where(F.col(key) > last).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def speeds(stream: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Sums per second."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 second")).agg(F.sum("value").alias("value")).select(F.col("window.start").alias("second"), "value")


#: Samples of a speed history: five minutes of one a second.
SAMPLES = 300


def speed_history(sums: DataFrame, most: int = SAMPLES) -> DataFrame:
    """The newest ``most`` seconds up to the last one of ``sums (second, value)``, in order; seconds without any are 0."""
    end = F.max(F.unix_seconds("second")).alias("_end")
    seconds = sums.agg(end).where("_end IS NOT NULL").select(F.explode(F.sequence(F.col("_end") - (most - 1), F.col("_end"))).alias("_s"))  # ``most`` rows
    have = sums.select(F.unix_seconds("second").alias("_s"), "value")
    first = sums.agg(F.min(F.unix_seconds("second")).alias("_first"))
    rows = seconds.join(have, "_s", "left").where(F.col("_s") >= first.scalar())
    return rows.select(F.timestamp_seconds("_s").alias("second"), F.coalesce("value", F.lit(0.0)).alias("value")).orderBy("second")


def typed(stream: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """A stream whose ``column`` holds one of ``names``; any other value stops it with an error that says which."""
    wrong = F.raise_error(F.concat(F.lit("no such event: "), F.coalesce(F.col(column), F.lit("null"))))
    return stream.withColumn(column, F.when(F.coalesce(F.col(column).isin(*names), F.lit(False)), F.col(column)).otherwise(wrong))
