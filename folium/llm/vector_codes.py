"""Operator 13: vector codes by a codebook a part, the nearest entry found through segment-mean lower bounds.

A vector's integers floor(256 x) are cut into equal parts; each part's codebook is refined in rounds of assigning every
part to its nearest entry and moving entries to the floor of their parts' means. A search of the nearest entry goes from
coarse to fine: with a part cut into segments, the squared distance of two parts is at least that of their segment means,
each times the segment's length, plus the squared difference of the norms of what the means leave. An entry stays while
that bound does not exceed the exact distance to the entry that the coarsest bound puts first. What stays after the
finest bound gets its exact integer distance, so that bounds only save work.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers up to this keep every distance and sum of a batch within 64 bits; beyond it, Python's integers are used.
PLAIN = 1 << 24
#: The share of the squared norms that a bound is lowered by, so that rounding never leaves a nearest entry out.
SLACK = 1e-9
#: Vectors that are searched at once.
ROWS = 2_000
#: Copies of each label's sum, dealt to as many tasks, so that a label's rows need not meet in one.
SALTS = 32
LONG = (1 << 63) - 1


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, exact: 64-bit integers where they are small, else Python's."""
    if np.abs(vectors).max(initial=0.0) <= PLAIN / SCALE:
        return np.floor(vectors * SCALE).astype(np.int64)
    exact = lambda x: math.floor(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE
    return np.array([[exact(x) for x in v] for v in vectors.tolist()], dtype=object).reshape(vectors.shape)


def _segments(width: int) -> list[list[int]]:
    """Where segments begin, from one segment to segments of one or two components, halving at each level."""
    levels, n = [], 1
    while True:
        levels.append([width * k // n for k in range(n)])
        if 2 * n > width:
            return levels
        n *= 2


def _measures(x: np.ndarray, level: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Segment means, each times the root of its segment's length, and the norm of what they leave."""
    lengths = np.diff([*level, x.shape[1]])
    means = np.add.reduceat(x, level, axis=1) / lengths
    rest = np.linalg.norm(x - np.repeat(means, lengths, axis=1), axis=1)
    return means * np.sqrt(lengths), rest


class Codebook:
    """One part's entries, with their measures at every level."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        if entries.dtype == object:
            return
        self.levels = _segments(entries.shape[1])
        real = entries.astype(np.float64)
        self.norms = (real * real).sum(axis=1)
        self.measures = [_measures(real, level) for level in self.levels]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least index of a nearest entry for each row, and its squared distance, exact."""
        if object in (x.dtype, self.entries.dtype):  # beyond what doubles can bound: all entries
            row, entry = (a.ravel() for a in np.indices((len(x), len(self.entries))))
        else:
            row, entry = self._survivors(x)
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)  # rows in order, and entries within a row
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(exact, first)
        place = np.flatnonzero(exact == least[row])
        tied = np.concatenate([[True], row[place][1:] != row[place][:-1]])
        return entry[place[tied]], least

    def _survivors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and an entry that may be a nearest one, by row, then entry."""
        real = x.astype(np.float64)
        norms = (real * real).sum(axis=1)
        own = [_measures(real, level) for level in self.levels]
        means, rest = own[0]
        centers, rests = self.measures[0]
        bound = (means - centers[:, 0]) ** 2 + (rest[:, None] - rests) ** 2
        limit = ((x - self.entries[bound.argmin(axis=1)]) ** 2).sum(axis=1).astype(np.float64)  # of an entry, so an upper bound
        slack = SLACK * (1 + norms[:, None] + self.norms)
        row, entry = np.nonzero(bound - slack <= limit[:, None] * (1 + SLACK))
        for (means, rest), (centers, rests) in zip(own[1:], self.measures[1:], strict=True):
            bound = ((means[row] - centers[entry]) ** 2).sum(axis=1) + (rest[row] - rests[entry]) ** 2
            keep = bound - slack[row, entry] <= limit[row] * (1 + SLACK)
            row, entry = row[keep], entry[keep]
        return row, entry


def vectors_of(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return column.values.slice(column.offsets[0].as_py(), len(column) * width).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(embeddings: DataFrame, parts: int = PARTS) -> DataFrame:
    """``vec_id, v, label`` of the rows whose vector can be cut into ``parts`` and has finite components alone."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = v.isNotNull() & finite & (F.size(v) > 0) & (F.size(v) % parts == 0)
    return embeddings.where(kept).select("vec_id", v.cast("array<double>").alias("v"), "label")


def _batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, integers(vectors_of(part.column(at)))


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Each part of the vectors of the least ids; of rows with one id the least vector counts."""
    ids = rows.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    found = rows.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").toArrow()  # `entries` rows
    if not found.num_rows:
        return []
    x = integers(vectors_of(found.column("v").combine_chunks()))
    return np.split(x, parts, axis=1)


def _moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round. Tasks sum the parts of each entry; a sum goes on in limbs of 32 bits, so it is exact."""
    holder = rows.sparkSession.sparkContext.broadcast(books)  # ENTRIES vectors

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in holder.value]
        sums = [np.zeros(b.entries.shape, dtype=object) for b in own]
        counts = np.zeros((len(own), len(own[0].entries)), np.int64)
        for _, x in _batches(batches, 0):
            for p, part in enumerate(np.split(x, len(own), axis=1)):
                code, _ = own[p].nearest(part)
                total = np.zeros(sums[p].shape, dtype=part.dtype)
                np.add.at(total, code, part)
                sums[p] = sums[p] + total.astype(object)
                counts[p] += np.bincount(code, minlength=len(counts[p]))
        out: list[tuple[int, int, int, int, int]] = []  # part, entry, place or -1 for the count, limb, value
        for p, e in zip(*np.nonzero(counts), strict=True):
            out.append((p, e, -1, 0, counts[p, e]))
            for place, value in enumerate(sums[p][e].tolist()):
                limb = 0
                while not -(1 << 31) <= value < 1 << 31:
                    out.append((p, e, place, limb, value & 0xFFFFFFFF))
                    value, limb = value >> 32, limb + 1
                out.append((p, e, place, limb, value))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(map(int, c), pa.int64()) for c in cols], names=["part", "entry", "place", "limb", "value"])

    summed = rows.select("v").mapInArrow(task, "part long, entry long, place long, limb long, value long").groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    new, counts = [b.astype(object) for b in books], {}
    totals: dict[tuple[int, int, int], int] = {}
    for p, e, place, limb, value in zip(*(c.to_pylist() for c in summed.toArrow().columns), strict=True):  # a few numbers a component
        if place < 0:
            counts[p, e] = value
        else:
            totals[p, e, place] = totals.get((p, e, place), 0) + (value << (32 * limb))
    for (p, e, place), total in totals.items():
        new[p][e, place] = total // counts[p, e]
    return [b.astype(np.int64) if max(abs(v) for v in b.flat) <= PLAIN else b for b in new]


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The refined codebooks of the vectors of :func:`usable`, one array a part."""
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = _moved(rows, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error``: the nearest entries as hex digits, and the squared distances, summed, as a decimal
    of 38 digits; null where it has more."""
    holder = rows.sparkSession.sparkContext.broadcast(books)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in holder.value]
        for batch, x in _batches(batches, 2):
            found = [book.nearest(part) for book, part in zip(own, np.split(x, len(own), axis=1), strict=True)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            hexed = codes.tobytes().hex()
            width = 2 * len(own)
            errors = [sum(d) for d in zip(*(d.tolist() for _, d in found), strict=True)]
            new = [pa.array([hexed[i * width : (i + 1) * width] for i in range(len(codes))], pa.string())]
            new.append(pa.array([str(e) if e < 10**38 else None for e in errors], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(task, f"{kinds}, code string, error string").withColumn("error", F.col("error").cast("decimal(38,0)"))


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` with ``approx``, the vector that a code stands for: its entries' integers over SCALE."""
    holder = codes.sparkSession.sparkContext.broadcast([b.astype(np.float64) / SCALE for b in books])
    names = codes.columns
    at = names.index("code")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for code in batch.column(at).to_pylist():
                made.append(None if code is None else np.concatenate([b[i] for b, i in zip(holder.value, bytes.fromhex(code), strict=True)]).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*names, "approx"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.mapInArrow(task, f"{kinds}, approx array<double>")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """The contract's columns: ``vec_id, code, error, label_error, codebooks_sha256``.

    Rows whose vector is null, empty, cannot be cut into ``parts`` equal parts, or holds a null or a non-finite
    component are left out; so are those of another length than the vector of the least id, which no entry could be
    compared with. Every other row gives one row, repeated rows equal ones. A null id is no id that a codebook begins
    with, but its row is encoded. With fewer ids than entries there are as many entries as ids. Null labels are one
    label. An error that no long can hold is null. An empty table gives no rows. Other columns are not read.
    """
    rows = usable(embeddings, parts)
    first = rows.where("vec_id IS NOT NULL").agg(F.min_by(F.size("v"), F.struct("vec_id", "v"))).first()[0]
    rows = rows.where(F.size("v") == F.lit(first))
    books = codebooks(rows, parts, entries, rounds)
    coded = cut(encode(rows, books)) if books else encode(rows.limit(0), books)
    fits = lambda c: F.when(F.col(c) <= F.lit(LONG), F.col(c)).cast("long")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")))
    return joined.select("vec_id", "code", fits("error").alias("error"), fits("label_error").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    near = "min({'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}) b"
    steps = ""
    for r in range(ROUNDS):
        steps += f"""
a{r} AS MATERIALIZED (SELECT rid, p, any_value(x) x, {near} FROM parts JOIN c{r} USING (p) GROUP BY rid, p),
s{r} AS (SELECT p, k, list(floor(t / n)::BIGINT ORDER BY i) y FROM (SELECT p, b.k k, i, sum(x[i]) t, count(*) n FROM (SELECT *, unnest(range(1, len(x) + 1)) i FROM a{r}) GROUP BY ALL) GROUP BY p, k),
c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(s.y, c.y) y FROM c{r} c LEFT JOIN s{r} s USING (p, k)),"""
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) v FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT rid, vec_id, p, v[p * m + 1:(p + 1) * m] x FROM (SELECT *, len(v) // {PARTS} m, unnest(range({PARTS})) p FROM e)),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 k FROM (SELECT DISTINCT vec_id FROM e WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {ENTRIES})),
c0 AS MATERIALIZED (SELECT p, k, min(x) y FROM parts JOIN ids USING (vec_id) GROUP BY p, k),{steps}
final AS (SELECT rid, p, {near} FROM parts JOIN c{ROUNDS} USING (p) GROUP BY rid, p),
coded AS (SELECT rid, string_agg(printf('%02x', b.k), '' ORDER BY p) code, sum(b.d) error FROM final GROUP BY rid)
SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, k)) FROM c{ROUNDS}) codebooks_sha256
FROM e JOIN coded USING (rid)
"""


ORACLE = _sql()
