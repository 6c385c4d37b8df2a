"""Running values over ordered rows, of any number and however many a key has.

Rows are dealt to ranges of (key, order), so that a key of many rows lies in several. Each range is summed up apart, the
few ranges of a key are summed in order, and what comes before a range is joined to its rows. No task sees more than a
range, and no window runs over a whole key or table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.shared import cut

PIECE = "_piece"

_OVER = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
_JOINED = {
    "sum": lambda before, own: F.coalesce(before + own, before, own),
    "count": lambda before, own: F.coalesce(before, F.lit(0).cast("long")) + own,
    "min": lambda before, own: F.least(before, own),
    "max": lambda before, own: F.greatest(before, own),
    "last": lambda before, own: F.coalesce(own, before),
}


def pieces(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``rows`` with the number of the range that each lies in, cut to a checkpoint, so that all passes see one dealing.

    Rows that are equal in keys and order lie in one range; give an order that tells rows apart.
    """
    return cut(rows.repartitionByRange(*keys, *order).withColumn(PIECE, F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str | Column], **values: tuple) -> DataFrame:
    """``rows``, from :func:`pieces`, with a column for each of ``values``: ``name=(how, column)`` is the sum, count, min,
    max or last value that is not null, per key and in order, up to a row; ``name=(how, column, False)`` leaves the row
    itself out. A sum or count of no rows is null or 0."""
    here = Window.partitionBy(PIECE, *keys).orderBy(*order)
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("_n", F.row_number().over(here))
    for name, (how, column, *own) in values.items():
        d = d.withColumn(f"_all_{name}", _OVER[how](column).over(upto))
        d = d.withColumn(name, F.col(f"_all_{name}") if own in ([], [True]) else _OVER[how](column).over(before))
    sums = d.groupBy(PIECE, *keys).agg(F.max_by(F.struct(*[f"_all_{n}" for n in values]), "_n").alias("_r"))
    ordered = Window.partitionBy(*keys).orderBy(PIECE)  # a row a range
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    add = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": _OVER["last"]}
    sums = sums.select(F.col(PIECE).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.row_number().over(ordered).alias("_at"), *[add[v[0]](f"_r._all_{n}").over(earlier).alias(f"_before_{n}") for n, v in values.items()])
    sums = sums.where("_at > 1").drop("_at")  # ranges with a part of their key before them: one a range at most
    same = F.col(PIECE) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d = d.join(F.broadcast(sums), same, "left")  # as many rows as there are partitions
    out = [_JOINED[how](F.col(f"_before_{name}"), F.col(name)).alias(name) for name, (how, *_) in values.items()]
    return d.select(*rows.columns, *out)


def numbered(rows: DataFrame, order: list[str | Column], name: str = "position", keys: list[str] | None = None) -> DataFrame:
    """``rows`` with their place in order from 0, in the whole table or per key."""
    d = running(pieces(rows, keys or [], order), keys or [], order, **{name: ("count", F.lit(1))})
    return d.withColumn(name, F.col(name) - 1).drop(PIECE)
