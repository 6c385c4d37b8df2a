"""Operator 4: vector best-fit packing of token pieces into sequences under several capacities."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm import tokens
from folium.llm.common import cut, parts

CAPACITY = 4096
#: Pieces packed together by one task, or more of them where they would fill fewer than so many sequences: a task leaves
#: its last ones part full. The number of tasks grows with the input.
SHARD, SEQUENCES = 10_000, 400
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity`` tokens only where they are more."""
    path = tokenizer or tokens.default_path()
    end = end_id.to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for a, b in parts(batch.column(1)):
                for doc_id, got in zip(ids[a:b], encode.encode_many(batch.column(1).slice(a, b - a)), strict=True):
                    whole = got + end
                    for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, PIECE)


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` must come in descending order.

    An item needs (length, 1, length ** 2) of a bin's tokens, documents and attention cost. Among the open bins
    that can take it under every capacity, ``rule`` "norm" picks the one with the least weighted norm of what stays
    free, "dot" the one with the largest weighted dot product of need and free capacity; ties go to the oldest bin.
    """
    cap = np.asarray(capacities, dtype=np.float64)
    weight = np.asarray(weights, dtype=np.float64)
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    room = np.empty((3, 64), dtype=np.float64)  # of open bins: tokens, documents, cost
    name = np.empty(64, dtype=np.int64)
    n = made = 0
    least = float(lengths[-1]) if len(lengths) else 0.0
    for i, length in enumerate(lengths.tolist()):
        need = (float(length), 1.0, float(length) * length)
        pick = -1
        if n:
            free = room[:, :n]
            fits = np.nonzero((free[0] >= need[0]) & (free[1] >= need[1]) & (free[2] >= need[2]))[0]
            if len(fits):
                held = free[:, fits]
                if rule == "dot":
                    score = -sum(weight[k] * need[k] / cap[k] * held[k] / cap[k] for k in range(3))
                else:
                    score = sum(weight[k] * ((held[k] - need[k]) / cap[k]) ** 2 for k in range(3))
                pick = int(fits[np.argmin(score)])
        if pick < 0:
            if need[1] > cap[1] or need[2] > cap[2] or need[0] > cap[0]:
                raise ValueError(f"a piece of {length} tokens exceeds a capacity")
            if n == room.shape[1]:
                room, name = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([name, np.empty_like(name)])
            room[:, n], name[n] = cap, made
            pick, n, made = n, n + 1, made + 1
        bins[i], offsets[i] = name[pick], int(cap[0] - room[0, pick])
        room[0, pick] -= need[0]
        room[1, pick] -= 1
        room[2, pick] -= need[2]
        if room[0, pick] < least or room[1, pick] < 1 or room[2, pick] < least * least:  # nothing more fits: close it, keeping the order of age
            room[:, pick : n - 1], name[pick : n - 1] = room[:, pick + 1 : n].copy(), name[pick + 1 : n].copy()
            n -= 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, max_docs: int = CAPACITY, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4), rule: str = "norm", shard: int = SHARD) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``.

    Pieces are dealt evenly to tasks of about ``shard`` pieces and ``SEQUENCES`` full sequences at least, whatever their
    ids, so that no source or group of copies gathers in one task; each task packs its own by best fit, longest first.
    The dealing number is stored with the pieces, so a task that runs again packs the same ones.

    With the default ``max_docs`` and ``max_cost`` only tokens can run out, as fewest sequences ask for: a piece has a
    token, and squares of lengths never sum to more than the square of the sum. Lower values bind.
    """
    caps = (float(capacity), float(max_docs), float(max_cost or capacity * capacity))
    held = cut(parts.withColumn("_n", F.monotonically_increasing_id()))
    length = F.col("length").cast("double")
    count, *needs = held.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0.0)) for x in (length, F.lit(1.0), length * length)]).first()
    sequences = max(need / cap for need, cap in zip(needs, caps, strict=True))
    tasks = max(1, min(-(-count // shard), math.ceil(sequences / SEQUENCES)))
    schema = PIECE + ", sequence_id long, offset long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("length", "descending"), ("_n", "ascending")])
        bins, offsets = best_fit(t.column("length").to_numpy(), caps, weights, rule)
        ids = bins + (TaskContext.get().partitionId() << 32)
        t = t.drop_columns(["_n"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
        yield from t.to_batches()

    return held.repartition(tasks, F.xxhash64("_n")).mapInArrow(task, schema)


def packed(docs: DataFrame, **options) -> DataFrame:
    """Documents packed into sequences: one row per piece.

    Null text counts as empty and gives the end id alone. Every row of ``docs`` is a document of its own, repeated
    ids and rows included; other columns are ignored. A text of any length is cut into pieces and nothing of it lost.
    Pieces that fit equally well go to the oldest sequence. An empty table gives no rows.
    """
    return pack(pieces(docs, capacity=options.get("capacity", CAPACITY)), **options)
