"""Operator 8: similarity join on word n-grams by chosen paths.

Sets are embedded by minhash coordinates. Each run splits all sets along paths: a node of the path tree picks one
coordinate by its own hash, and sets that share the value there go to the same child. A node with few sets is brute
forced; one with many splits again, as deep as the runs still reach the target recall, and is then brute forced in
blocks. Brute force on sketches joins candidates into provisional groups, and all pairs of a group are then compared by
their exact sets.

No step emits the pairs of a group: sketches and sets are compared in blocks inside tasks, which give out spanning
links and link counts, so that a group of many near copies costs rows in proportion to its members.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import components, cut, groups, kept_by_worker

#: Words of an n-gram, and the least similarity as a fraction.
NGRAM, THRESHOLD = 5, (4, 5)
#: Most share of the pairs at the threshold that all runs together may miss; see :func:`levels`.
MISSED = 2e-5
#: Minhash coordinates, the least share of equal ones of a candidate (which drops 10^-6 of the pairs at the threshold),
#: runs, the most sets of a node that does not split again, and rows of a block of an oversized node.
COORDINATES, CANDIDATE, RUNS, LEAF, BLOCK = 96, 0.59, 16, 2048, 2048
#: Shingles of a block of a group that is compared exactly.
BLOCK_SHINGLES = 2_000_000
#: Candidates up to this number go to every task; more are joined by a shuffle.
SMALL = 50_000
MEMO = 150_000
_WORD = re.compile(r"[^\x20\t-\r]+")
_U = np.uint64
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, COORDINATES, dtype=_U) * _U(2) + _U(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=_U)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The sorted set of a text's lower-cased word n-grams as 64-bit hashes; a shorter text is one n-gram of its words."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=_U, count=len(words))
    size = max(1, len(words) - n + 1)
    out = np.full(size, min(n, len(words)), dtype=_U)
    for k in range(min(n, len(words))):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + size])
    return np.unique(out)


def minhash(items: np.ndarray) -> np.ndarray:
    """The least hash of a set in each coordinate."""
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(items), 2048):
        part = items[a : a + 2048]
        out = np.minimum(out, ((part[None, :] * _A[:, None] + _B[:, None]) >> _U(32)).min(axis=1).astype(np.uint32))
    return out


def set_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``set_key``, the key of each text's set of n-grams, null without words. For a few rows: it hashes whole texts."""
    at, schema = docs.columns.index(text), docs.withColumn("set_key", F.lit(None).cast("binary")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker(None)
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(at)]
            told = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, told], names=[*batch.schema.names, "set_key"])

    return docs.mapInArrow(task, schema)


def _sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, set_key, n_shingles, sketch``; key and sketch are null for a text without words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker(None)
        for batch in batches:
            keys, sizes, out = [], [], []
            for text in batch.column(1):
                items = shingles(text.as_py())
                keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                sizes.append(len(items))
                out.append(minhash(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "set_key", "n_shingles", "sketch"])

    return docs.mapInArrow(task, "doc_id long, set_key binary, n_shingles long, sketch binary")


def _step(nodes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The children of path nodes (rows x runs): each node picks a coordinate, the sketch's value there the child."""
    picked = (_mix(nodes) % _U(COORDINATES)).astype(np.int64)
    return _mix(nodes * _U(0x9E3779B97F4A7C15) + np.take_along_axis(sketch, picked, axis=1).astype(_U) + _U(1))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _roots(reps: DataFrame, runs: int) -> DataFrame:
    """``rep, node`` after each run's first step."""
    seeds = _mix(np.arange(1, runs + 1, dtype=_U))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = _step(np.tile(seeds, (batch.num_rows, 1)), _matrix(batch.column(1)))
                flat = pa.array(nodes.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, runs, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["rep", "nodes"])

    return reps.select("rep", "sketch").mapInArrow(task, "rep long, nodes array<long>").select("rep", F.explode("nodes").alias("node"))


def _children(rows: DataFrame) -> DataFrame:
    """``rep, node`` one step further down, from ``rep, node, sketch``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = batch.column(1).to_numpy().view(_U).reshape(-1, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_step(nodes, _matrix(batch.column(2))).view(np.int64).ravel())], names=["rep", "node"])

    return rows.select("rep", "node", "sketch").mapInArrow(task, "rep long, node long")


def levels(runs: int, threshold: tuple[int, int]) -> int:
    """The most levels of a path at which ``runs`` runs miss no more than MISSED of the pairs at the threshold; at least one.

    A pair of similarity s stays together for k levels with probability s^k, so all runs miss it with (1 - s^k)^runs.
    """
    s, k = threshold[0] / threshold[1], 1
    while s < 1 and (1 - s ** (k + 1)) ** runs <= MISSED:
        k += 1
    return k


def _leaves(reps: DataFrame, runs: int, most: int) -> DataFrame:
    """``rep, node, count``: the nodes at which paths end, after ``most`` levels at the deepest, with at least two sets each."""
    live, ends = _roots(reps, runs), []
    for level in range(most):
        counts = cut(live.groupBy("node").agg(F.count("*").alias("count")).where("count > 1"))  # apart, so that a hot node's join can be split
        live = cut(live.join(counts, "node").select("rep", "node", "count"))
        if level + 1 == most:
            ends.append(live)
            break
        ends.append(live.where(F.col("count") <= LEAF))
        large = live.where(F.col("count") > LEAF)
        if large.isEmpty():
            break
        live = cut(_children(large.join(reps.select("rep", "sketch"), "rep")))  # counted and joined: made once
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def in_blocks(rows: DataFrame, key: str, blocks, salt: str) -> DataFrame:
    """``rows`` once per pair of blocks (i <= j) of their group that holds them, as ``task_key, block``.

    ``blocks`` is the number of blocks of a row's group. Both members of any pair meet in just one task: in that of
    their blocks. A group of one block is one task.
    """
    d = rows.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    d = d.withColumn("_other", other)
    return d.withColumn("task_key", F.xxhash64(key, F.least("block", "_other"), F.greatest("block", "_other"))).drop("_blocks", "_other")


def forest(n: int, linked: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph on n nodes whose edges ``linked(some, others)`` tells as a matrix.

    Nodes that have been reached are compared with those that have not, ``rows`` at a time; so a dense group costs
    about one comparison per member.
    """
    out: list[tuple[int, int]] = []
    left = np.arange(n)
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:rows], front[rows:]
            hit = linked(some, left)
            found = hit.any(axis=0)
            if found.any():
                new = left[found]
                out += zip(some[hit[:, found].argmax(axis=0)].tolist(), new.tolist(), strict=True)
                front, left = np.concatenate([front, new]), left[~found]
    return out


def _candidates(leaves: DataFrame, reps: DataFrame) -> DataFrame:
    """Spanning links ``a, b`` of sets whose sketches agree in CANDIDATE of the coordinates, within each leaf."""
    rows = leaves.join(reps.select("rep", "sketch"), "rep")
    rows = in_blocks(rows, "node", F.ceil(F.col("count") / BLOCK), "leaf").select("task_key", "block", "rep", "sketch")
    least = CANDIDATE * COORDINATES

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task_key"):
            ids = t.column("rep").to_numpy()
            if len(ids) > 1:
                s = _matrix(t.column("sketch"))
                linked = lambda a, b: (s[a][:, None, :] == s[b][None, :, :]).sum(axis=2) >= least  # noqa: B023, E731
                pairs = forest(len(ids), linked, max(1, 20_000 // len(ids)))
                if pairs:
                    a, b = np.array(pairs).T
                    yield pa.RecordBatch.from_pydict({"a": ids[a], "b": ids[b]})

    return rows.repartition("task_key").sortWithinPartitions("task_key").mapInArrow(task, "a long, b long")


def _with_sets(docs: DataFrame, active: DataFrame) -> DataFrame:
    """``active`` with the exact set of each representative, made again from its text."""
    names = ["rep", "root", "copies", "group_size", "group_shingles"]
    side = F.broadcast(active) if active.count() <= SMALL else active
    rows = docs.join(side, "doc_id").select(*names, "set_key", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sets = [], []
            for i, (key, text) in enumerate(zip(batch.column(5), batch.column(6), strict=True)):
                items = shingles(text.as_py())
                if xxhash.xxh3_128_digest(items.tobytes()) == key.as_py():  # rows may share an id
                    keep.append(i)
                    sets.append(items.tobytes())
            part = batch.select(names).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets, pa.binary())], names=[*names, "items"])

    return rows.mapInArrow(task, "rep long, root long, copies long, group_size long, group_shingles long, items binary")


def overlaps(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of incidence matrices over ``width`` shared items at a time."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
    shared = np.bincount(number)[number] > 1
    number, owner = number[shared], owner[shared]
    number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]])) if len(number) else number
    out = np.zeros((n, n), dtype=np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [a, a + width])
        rows, mine = np.unique(owner[lo:hi], return_inverse=True)
        x = np.zeros((len(rows), width), dtype=np.float32)
        x[mine, number[lo:hi] - a] = 1
        out[np.ix_(rows, rows)] += x @ x.T
    return out


def _verified(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Exact links within each group: per representative a row ``a, n`` with its links, and spanning links ``a, b``."""
    p, q = threshold
    blocks = F.greatest(F.ceil(F.col("group_size") / BLOCK), F.ceil(F.col("group_shingles") / BLOCK_SHINGLES))
    rows = in_blocks(sets, "root", blocks, "group").select("task_key", "block", "rep", "copies", "items")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task_key"):
            _, first = np.unique(t.column("rep").to_numpy(), return_index=True)  # repeated rows
            t = t.take(pa.array(first))
            ids, block, copies = (t.column(c).to_numpy() for c in ("rep", "block", "copies"))
            if len(ids) < 2:
                continue
            items = [np.frombuffer(x, dtype=_U) for x in t.column("items").to_pylist()]
            size = np.array([len(x) for x in items], dtype=np.float64)
            link = overlaps(items) * (p + q) >= p * (size[:, None] + size[None, :])
            if block.min() != block.max():  # pairs of one block are told by that block's own task
                link &= block[:, None] != block[None, :]
            np.fill_diagonal(link, False)
            n = link @ copies
            pairs = forest(len(ids), lambda a, b: link[np.ix_(a, b)], 512)  # noqa: B023
            some = np.nonzero(n)[0]
            ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[some], ids[ends[:, 0]]])), pa.array([None] * len(some) + ids[ends[:, 1]].tolist(), pa.int64()), pa.array(np.concatenate([n[some], np.zeros(len(ends), np.int64)]).astype(np.int64))],
                names=["a", "b", "n"],
            )

    return rows.repartition("task_key").sortWithinPartitions("task_key").mapInArrow(task, "a long, b long, n long")


def ngram_join(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, runs: int = RUNS, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """``doc_id, class_id, n_links, set_size`` for every row of ``docs``; with ``keys``, the key of its set too.

    Two documents are linked when the Jaccard similarity of their sets of lower-cased word n-grams is at least the
    threshold; equal sets count as copies. ``n_links`` is the number of other documents linked to a row, copies
    included; ``class_id`` is the least id that links reach. Null and empty texts and texts of white space have no
    n-gram and link with nothing: class_id is their own id. Rows with a null id link with nothing and have a null
    class. Repeated rows are copies of each other, and each counts as a link of the others. A
    text of any length is one set of all its n-grams. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = cut(_sketches(docs))
    known = sketched.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    reps = cut(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    shared = reps.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1")  # one id, several texts: told apart by a number below
    many = shared.select("rep")
    number = F.when(F.col("many").isNotNull(), -F.abs(F.xxhash64("set_key"))).otherwise(F.col("rep"))
    reps = reps.join(many.withColumn("many", F.lit(1)), "rep", "left").withColumn("number", number)
    out = _joined(docs, sketched, reps, threshold, runs)
    return out if keys else out.drop("set_key")


def _joined(docs: DataFrame, sketched: DataFrame, reps: DataFrame, threshold: tuple[int, int], runs: int) -> DataFrame:
    inner = cut(reps.select(F.col("number").alias("rep"), F.col("rep").alias("doc_id"), "set_key", "copies", "n_shingles", "sketch"))
    links = cut(_candidates(_leaves(inner, runs, levels(runs, threshold)), inner).distinct())
    groups_ = components(links)
    active = groups_.withColumnRenamed("node", "rep").join(inner.select("rep", "doc_id", "set_key", "copies", "n_shingles"), "rep")
    sizes = active.groupBy("root").agg(F.count("*").alias("group_size"), F.sum("n_shingles").alias("group_shingles"))
    active = cut(active.join(sizes, "root").select("rep", "doc_id", "root", "copies", "group_size", "group_shingles", "set_key"))
    found = cut(_verified(_with_sets(docs, active), threshold))
    classes = components(found.where("b is not null").select("a", "b"))
    extra = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = inner.select(F.col("rep").alias("node"), "set_key", "copies", "doc_id").join(classes, "node", "left").join(extra, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    told = named.join(least, "root").select("set_key", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    bare = sketched.drop("sketch")  # texts without words link with nothing; as null keys they would all go to one task
    out = bare.where("set_key IS NOT NULL").join(told, "set_key", "left").unionByName(bare.where("set_key IS NULL"), allowMissingColumns=True)
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(own, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.col("n_shingles").alias("set_size"), "set_key")


def audit(docs: DataFrame, joined: DataFrame, sample: int = 200, threshold: tuple[int, int] = THRESHOLD) -> tuple[int, int]:
    """The links that ``joined`` has, and that there are, of about ``sample`` different sets against all of ``docs``.

    Sets are drawn by a hash of their keys from those that the join linked with anything, and as many from the others;
    their n-grams go to every task, which counts those that a text shares with each. ``joined`` has the sets' keys
    (``keys=True``), ``docs`` columns doc_id and text. It is for reports: the join does not wait for it.
    """
    spark, (p, q) = docs.sparkSession, threshold
    sets = cut(joined.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.max("n_links").alias("n"), F.min("doc_id").alias("doc_id")))
    sizes = {r["some"]: r["count"] for r in sets.groupBy((F.col("n") > 0).alias("some")).count().collect()}  # two rows
    share = F.when(F.col("n") > 0, F.lit(sample / 2 / max(1, sizes.get(True, 0)))).otherwise(F.lit(sample / 2 / max(1, sizes.get(False, 0))))
    drawn = sets.where(F.pmod(F.xxhash64(F.lit("audit"), "set_key"), F.lit(1 << 30)) / float(1 << 30) < share)
    asked = set_keys(docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id", F.col("set_key").alias("k"), "n")), "doc_id")).where("k = set_key").dropDuplicates(["k"]).collect()  # about ``sample`` texts
    if not asked:
        return 0, 0
    own = [shingles(r["text"]) for r in asked]
    flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
    order = np.argsort(flat, kind="stable")
    holder = spark.sparkContext.broadcast((flat[order], owner[order], np.array([len(x) for x in own])))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, whose, size = holder.value
        links = np.zeros(len(size), np.int64)
        for batch in batches:
            for text in batch.column(0):
                items = shingles(text.as_py())
                lo, hi = np.searchsorted(known, items, "left"), np.searchsorted(known, items, "right")
                some = np.nonzero(hi > lo)[0]
                if len(some):
                    shared = np.bincount(np.concatenate([whose[a:b] for a, b in zip(lo[some], hi[some], strict=True)]), minlength=len(size))
                    links += shared * (p + q) >= p * (size + len(items))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(size)), pa.int32()), pa.array(links)], names=["i", "n"])

    true = {r["i"]: r["n"] - 1 for r in docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(task, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # less itself
    return sum(min(r["n"], true[i]) for i, r in enumerate(asked)), sum(true.values())


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) END) g FROM d),
n AS (SELECT rid, count(*) n FROM s GROUP BY rid),
inter AS (SELECT a.rid x, b.rid y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 9 * c >= 4 * (p.n + q.n)),
reach AS (SELECT rid r, rid t FROM d UNION SELECT reach.r, link.y FROM reach JOIN link ON link.x = reach.t),
class AS (SELECT r rid, min(e.doc_id) class_id FROM reach JOIN d e ON e.rid = t GROUP BY r),
deg AS (SELECT x rid, count(*) k FROM link GROUP BY x)
SELECT doc_id, class_id, coalesce(k, 0)::BIGINT n_links, coalesce(n, 0)::BIGINT set_size
FROM d JOIN class USING (rid) LEFT JOIN deg USING (rid) LEFT JOIN n USING (rid)
"""
