"""Operator 6: length-delimited binary token records with masked checksums and a separate offset index.

A data file is a run of frames: length (u64), masked CRC-32C of the length (u32), payload, masked CRC-32C of the
payload (u32), all little-endian. A payload is a flag for a null id (u8), the id (i64) and the token ids at 2 or 4
bytes each. The index file beside it holds, per frame, its offset and the tokens of the file before it (u64 each), so
that a reader may visit any frames in any order and still knows where each stands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm import tokens
from folium.llm.common import cut, parts, scratch

HEAD = 9
#: Frames that one task reads back, of one file.
FRAMES = 20_000


def _payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    body = np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if width == 2 else ids
    return (b"\x00" if doc_id is None else b"\x01") + int(doc_id or 0).to_bytes(8, "little", signed=True) + body


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in ascending id order (nulls first, ties by text) below ``folder``; one row per file written.

    A file belongs to one range of ids and one task. It is written under the attempt's own name and renamed when
    whole, so a task that runs again after a lost executor leaves the same files. Null and empty texts give the end
    id alone. Returns ``part, path, n_records, n_tokens, width``.
    """
    path = tokenizer or tokens.default_path()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        encode = tokens.encoder(path)
        width = 2 if encode.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end = end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        own = f"{base}/part-{part:06d}"
        trial = f"{own}.{TaskContext.get().taskAttemptId()}"
        data = index = None
        at = records = total = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in parts(texts):
                rows = [_payload(i, x + end, width) for i, x in zip(ids[a:b], encode.encode_many(texts.slice(a, b - a)), strict=True)]
                if data is None:
                    data, index = store.open_output_stream(f"{trial}.rec.tmp"), store.open_output_stream(f"{trial}.idx.tmp")
                sizes = np.array([len(r) for r in rows], dtype="<u8")
                heads = [x.tobytes() for x in sizes]
                head_crc = tokens.masked(tokens.crc32c(heads)).astype("<u4")
                body_crc = tokens.masked(tokens.crc32c(rows)).astype("<u4")
                data.write(b"".join(x for h, hc, r, rc in zip(heads, head_crc, rows, body_crc, strict=True) for x in (h, hc.tobytes(), r, rc.tobytes())))
                lengths = (sizes - np.uint64(HEAD)) // np.uint64(width)
                ends, upto = np.cumsum(sizes + np.uint64(16)) + np.uint64(at), np.cumsum(lengths) + np.uint64(total)
                index.write(np.stack([np.append(np.uint64(at), ends[:-1]), np.append(np.uint64(total), upto[:-1])], axis=1).astype("<u8").tobytes())
                at, records, total = int(ends[-1]), records + len(rows), int(upto[-1])
        if data is not None:
            data.close()
            index.close()
            for kind in ("rec", "idx"):
                store.move(f"{trial}.{kind}.tmp", f"{own}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [own], "n_records": [records], "n_tokens": [total], "width": [width]})

    return d.mapInArrow(task, "part long, path string, n_records long, n_tokens long, width long")


def read(manifest: DataFrame, folder: str, frames: int = FRAMES, seed: int = 6) -> DataFrame:
    """Read files of :func:`write` back by their index, each task up to ``frames`` frames of a file in shuffled order.

    Every frame is sought by its offset and both its checksums are tested. Returns ``doc_id, start, n_tokens,
    ids_crc32``; start counts the tokens of all files and frames before it.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    files = manifest.select("path", "width", "n_records", F.coalesce(before, F.lit(0)).alias("base"))
    tasks = manifest.agg(F.sum(F.ceil(F.col("n_records") / frames))).first()[0] or 1
    parts = files.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1, F.lit(frames).cast("long")))).repartition(int(tasks))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                many = min(frames, row["n_records"] - row["first"])
                with store.open_input_file(f"{row['path']}.idx") as f:
                    held = f.read_at(16 * (many + 1), 16 * row["first"])
                index = np.frombuffer(held, dtype="<u8").reshape(-1, 2).astype(np.int64)
                kind = "<u2" if row["width"] == 2 else "<u4"
                order = np.random.default_rng([seed, row["first"]]).permutation(many)
                with store.open_input_file(f"{row['path']}.rec") as f:
                    ends = np.append(index[1:, 0], f.size())
                    for a in range(0, many, 500):
                        picked = order[a : a + 500]
                        got = [f.read_at(ends[i] - index[i, 0], index[i, 0]) for i in picked.tolist()]
                        heads, bodies = [x[:8] for x in got], [x[12:-4] for x in got]
                        if any(int.from_bytes(h, "little") != len(x) for h, x in zip(heads, bodies, strict=True)):
                            raise ValueError(f"{row['path']}: a frame is not as long as it says")
                        want = np.array([(int.from_bytes(x[8:12], "little"), int.from_bytes(x[-4:], "little")) for x in got], dtype=np.uint32).reshape(-1, 2)
                        if (tokens.masked(tokens.crc32c(heads)) != want[:, 0]).any() or (tokens.masked(tokens.crc32c(bodies)) != want[:, 1]).any():
                            raise ValueError(f"{row['path']}: checksum differs")
                        ids = [np.frombuffer(body, dtype=kind, offset=HEAD).astype("<u4") for body in bodies]
                        doc_id = [int.from_bytes(body[1:HEAD], "little", signed=True) if body[0] else None for body in bodies]
                        cols = [doc_id, index[picked, 1] + row["base"], [len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs``, read the files back, and return what the files say.

    Null and empty texts have the end id alone, a text of any length is one record, repeated rows are records of their
    own, and columns other than the id and the text are not read. An empty table gives no files and no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "records")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return read(cut(write(docs, folder, tokenizer, end_id)), folder)
