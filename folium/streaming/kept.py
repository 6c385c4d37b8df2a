"""Tables that a stream keeps: numbered lines of which the newest are read, and a hook that fires on changes.

Both are written by micro-batch under the batch's number, and a batch counts once a line says so, so that one that runs
again after a loss writes the same and one that counts is left alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from folium.operators.ordered import keep_one
from folium.operators.queue import at_least
from folium.operators.scans import numbered
from folium.shared import exists
from folium.sources.keyed_log import KeyedLog


class LogRing:
    """Log lines with sequence numbers that go on over batches and restarts; the newest ``most`` are the ring.

    Every line is written once, in its batch's folder. The ring is read from the folders that its numbers lie in, however
    many lines there were before. Lines of INFO and worse go on to who listens; the others are kept only.
    """

    def __init__(self, spark: SparkSession, root: str, most: int) -> None:
        self.spark, self.root, self.most = spark, root.rstrip("/"), max(most, 1)

    def batches(self) -> list[tuple[int, int, int]]:
        """``batch, first, last`` number of each batch that counts, in order of numbers."""
        if not exists(self.spark, f"{self.root}/_batches"):
            return []
        rows = self.spark.read.schema("batch long, first long, last long").json(f"{self.root}/_batches").distinct().collect()  # a line a batch
        return sorted(map(tuple, rows), key=lambda r: (r[1], r[2]))

    def add(self, lines: DataFrame, batch: int, order: list[str]) -> None:
        """Number a batch's lines in ``order`` after the last number, and keep them. A batch that counts is left alone."""
        counted = self.batches()
        if any(b == batch for b, _, _ in counted):
            return
        first = max((last for _, _, last in counted), default=0) + 1
        path = f"{self.root}/lines-{batch}"
        numbered(lines, order, "seq").withColumn("seq", (F.col("seq") + first).cast("long")).write.mode("overwrite").parquet(path)
        last = first - 1 + self.spark.read.parquet(path).count()
        line = json.dumps({"batch": batch, "first": first, "last": last})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/_batches")

    def _read(self, batches: list[int]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/lines-{b}" for b in batches]) if batches else None

    def newest(self, limit: int | None = None) -> DataFrame | None:
        """The ring, or the newest ``limit`` of it, in order; None before any line came."""
        n = min(self.most, self.most if limit is None else limit)
        counted = self.batches()
        end = max((last for _, _, last in counted), default=0)
        rows = self._read([b for b, first, last in counted if first <= last and last > end - n])
        return None if rows is None else rows.where(F.col("seq") > end - n).orderBy("seq")

    def published(self, after: int) -> DataFrame | None:
        """Lines past a number that listeners get: INFO and worse."""
        rows = self._read([b for b, first, last in self.batches() if first <= last and last > after])
        return None if rows is None else rows.where((F.col("seq") > after) & at_least("INFO")).orderBy("seq")

    def follow(self, stream: DataFrame, order: list[str]) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(lambda lines, batch: self.add(lines, batch, order))


def on_change(stream: DataFrame, log: KeyedLog, order: list[Column], watched: list[str], hook: Callable[[DataFrame, int], None], compact_every: int = 50) -> DataStreamWriter:
    """Keep each key's newest row of a stream in ``log``, and call ``hook(rows, batch)`` with the rows whose ``watched``
    columns differ, null-safe, from what was kept, or whose key is new; not at all where there are none.

    Of a batch's rows of one key the last in ``order`` counts. The batch is written, then the hook is called, then the
    batch counts: after a loss in between, the hook may be called again, with the same rows under the same number. The
    log is folded every ``compact_every`` batches, so that reading it stays bounded.
    """
    names = [c for c in log.schema.names if c != "gone"]

    def batch(rows: DataFrame, number: int) -> None:
        run = 2 * number  # the runs between are for folding
        if log.counts(run):
            return
        last = keep_one(rows, [F.col(k) for k in log.keys], order).select(*names)
        kept = log.current().select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(log.keys)], F.struct(*watched).alias("_kept"))
        same = F.lit(True)
        for i, k in enumerate(log.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        differs = F.col("_kept").isNull() | ~F.col("_kept").eqNullSafe(F.struct(*watched))
        changed = log.write(last.join(kept, same, "left").where(differs).select(*names), run).drop("gone")
        if not changed.isEmpty():
            hook(changed, number)
        log.count(run)
        if number % compact_every == compact_every - 1:
            log.compact(run + 1)

    return stream.writeStream.foreachBatch(batch)
