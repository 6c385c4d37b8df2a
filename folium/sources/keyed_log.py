"""A table kept as a log of runs: each run writes the rows that it changed, beside the runs before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.shared import exists


class KeyedLog:
    """The newest row of each key, out of runs that each changed some keys; ``gone`` rows take their key out.

    A run counts once its line is in ``_runs``; until then readers see the table as it was, and a run that died half-way
    is written anew by its next try. A run that counts is never written again, so that repeating it changes nothing.
    :meth:`compact` folds the log into one full run.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str]) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema = spark.createDataFrame([], f"{schema}, gone boolean").schema

    def runs(self) -> list[tuple[int, bool]]:
        """Runs that count, and whether each is a full table."""
        if not exists(self.spark, f"{self.root}/_runs"):
            return []
        return sorted(map(tuple, self.spark.read.schema("run long, whole boolean").json(f"{self.root}/_runs").distinct().collect()))  # a line a run

    def counts(self, run: int) -> bool:
        return any(n == run for n, _ in self.runs())

    def changed(self, run: int) -> DataFrame:
        """The rows that a run wrote."""
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/run-{run}")

    def current(self) -> DataFrame:
        runs = self.runs()
        full = max((n for n, whole in runs if whole), default=-1)
        parts = [self.changed(n).withColumn("_run", F.lit(n)) for n, _ in runs if n >= full]
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop("gone")
        rows = reduce(DataFrame.unionByName, parts)
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in self.keys]), "_run").alias("r"))
        return newest.where("NOT r.gone").select(*self.keys, *[F.col("r")[c].alias(c) for c in self.schema.names if c not in (*self.keys, "gone")])

    def write(self, rows: DataFrame, run: int) -> DataFrame:
        """Write a run that does not count yet; what was written."""
        rows = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/run-{run}")
        return self.changed(run)

    def count(self, run: int, whole: bool = False) -> None:
        self.spark.createDataFrame([(run, whole)], "run long, whole boolean").coalesce(1).write.mode("append").json(f"{self.root}/_runs")

    def commit(self, rows: DataFrame, run: int, whole: bool = False) -> bool:
        """Write and count a run; whether it was one that did not count yet."""
        if self.counts(run):
            return False
        self.write(rows, run)
        self.count(run, whole)
        return True

    def compact(self, run: int) -> bool:
        return self.commit(self.current(), run, whole=True)
