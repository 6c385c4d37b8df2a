"""Operator 9: embedding near-duplicates by a robust-pruned flat graph.

Unit vectors are dealt to overlapping cells of a k-means clustering: a vector goes to its nearest center and, as a
guest, to every center whose border is nearer than half the widest link, so one end of any link is at home in a cell
that holds the other too. Cells that are still large are clustered again in the same way, as deep as it takes. Each
cell is a task that builds a pruned neighbour graph over its members; the adjacency lists of a vector from all its
cells are united; range searches for the members at home then start at the cell's medoid, descend greedily to the
query and widen over neighbours in range. Each task audits its own recall on every AUDIT-th query, itself left out, and
on more of them until it has seen enough links to judge by, if need be on all; what an audit finds is kept, and the whole
cell is searched where the graph falls short. As every link has a cell where one end is at home, the audits see
all links of the audited members.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import components, cut, groups
from folium.llm.ngram_join import forest

log = logging.getLogger(__name__)

THRESHOLD = 0.98
#: Vectors that the centers of a cell are fitted on, about so many, and members that a cell is made for.
SAMPLE, CELL = 4_000, 2_000
#: Most members of a task: larger cells are clustered again, or searched in pairs of blocks where a split would repeat
#: its members as often as the blocks do. Members of one task of the dealing, and rounds of clustering at most.
BLOCK, DEAL, LEVELS = 5_000, 20_000, 8
#: Neighbours per vector, nearest and far candidates to prune from, pruning slack, and the beam of the greedy search.
DEGREE, POOL, FAR, ALPHA, BEAM = 16, 40, 40, 1.2, 24
#: Queries audited at first, one in so many; the links that an audit must see to tell the recall; the least recall.
AUDIT, SEEN, RECALL = 20, 40, 0.95
#: Queries that a task searches in step, and numbers of a block of vectors that are multiplied at once.
STEP, NUMBERS = 256, 1_500_000


def unit(raw: list | None) -> np.ndarray | None:
    """The vector over its length in double precision; None for null, zero, or non-finite ones, which link with nothing."""
    if raw is None or not len(raw) or any(x is None for x in raw):
        return None
    v = np.asarray(raw, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / math.sqrt(float(v @ v))


def _usable(vectors: DataFrame) -> DataFrame:
    """``number, label, unit`` of the vectors that may link, once per different vector of a label, with their copies."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit(x) for x in batch.column(2).to_pylist()]
            keep = pa.array([i for i, u in enumerate(units) if u is not None], pa.int64())
            raw = pa.array([u.tobytes() for u in units if u is not None], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), raw], names=["vec_id", "label", "unit"])

    rows = vectors.where(F.col("label").isNotNull()).select(F.col("vec_id").cast("long"), "label", "embedding")
    return rows.mapInArrow(task, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, unit binary")


_DEALT = "number long, cell long, unit binary, children array<long>"


def _centers(rows: DataFrame, sizes: DataFrame, rounds: int = 8) -> DataFrame:
    """``cell, centers``: as bytes, about n / CELL of them for each cell of ``sizes (cell, n)``, from about SAMPLE of its vectors."""
    place = F.pmod(F.xxhash64(F.lit("centers"), "number"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(sizes, "cell").where(place < F.lit(float(SAMPLE)) / F.col("n")).select("cell", "n", "unit")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "cell"):
            x = np.array([np.frombuffer(r) for r in sorted(t.column("unit").to_pylist())])
            k = max(2, min(SAMPLE // 8, -(-t.column("n")[0].as_py() // CELL)))
            c = x[np.random.default_rng(9).choice(len(x), min(len(x), k), replace=False)]
            for _ in range(rounds):
                near = (x @ c.T).argmax(axis=1)
                sums = np.zeros_like(c)
                np.add.at(sums, near, x)
                size = np.linalg.norm(sums, axis=1, keepdims=True)
                c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
            yield pa.RecordBatch.from_pydict({"cell": [t.column("cell")[0].as_py()], "centers": pa.array([c.tobytes()], pa.binary())})

    return drawn.repartition("cell").sortWithinPartitions("cell").mapInArrow(task, "cell long, centers binary")


def places(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home center of each vector, and whether it belongs to each center's cell.

    A link is at most d = sqrt(2 - 2t) long. Where its ends u and v have different homes, the plane between the two
    centers crosses it, so the end nearer to the plane is within d / 2 of it. A vector is put into every cell whose
    plane is that near, so this end joins the other end's home and no link is lost, in any direction.
    """
    far = np.maximum(0, 2 - 2 * (x @ c.T))
    own = far.argmin(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[own] @ c.T)))
    inside = far - far[np.arange(len(x)), own][:, None] <= math.sqrt(2 - 2 * threshold) * apart + 1e-9
    inside[np.arange(len(x)), own] = True
    return own, inside


def _dealt(rows: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """The members of the cells of ``sizes`` with the smaller cells that hold each, its home first.

    A cell's members meet its centers in tasks of about DEAL members, however many the cell has.
    """
    parts = F.ceil(F.col("n") / DEAL).cast("long")
    held = rows.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("number"), parts).alias("part"), "number", "unit", F.lit(None).cast("binary").alias("centers"))
    told = _centers(rows, sizes).join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("binary").alias("unit"), "centers")
    both = held.unionByName(told).withColumn("task_key", F.xxhash64("cell", "part"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task_key"):
            raw, cell = t.column("unit").to_pylist(), t.column("cell")[0].as_py()
            rows = [i for i, r in enumerate(raw) if r is not None]
            if not rows:
                continue
            x = np.array([np.frombuffer(raw[i]) for i in rows])
            c = np.frombuffer(next(r for r in t.column("centers").to_pylist() if r is not None)).reshape(-1, x.shape[1])
            names = [xxhash.xxh3_64_intdigest(f"{cell}/{i}") - (1 << 63) for i in range(len(c))]
            own, inside = places(x, c, threshold)
            children = [[names[o], *[names[j] for j in np.nonzero(row)[0] if j != o]] for o, row in zip(own, inside, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("number").take(pa.array(rows)).combine_chunks(), pa.array([cell] * len(rows)), pa.array([raw[i] for i in rows], pa.binary()), pa.array(children, pa.list_(pa.int64()))], names=["number", "cell", "unit", "children"])

    return both.repartition("task_key").sortWithinPartitions("task_key").mapInArrow(task, _DEALT)


def cells(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``number, cell, home, unit``: the cells of each of ``members (number, label, unit)``, and whether it searches there.

    It starts with one cell for each label and length. Cells of over BLOCK members are dealt out, unless that would
    repeat a member as often as pairs of blocks do, which then are the way to search the cell.
    """
    live = members.select("number", F.xxhash64("label", F.length("unit")).alias("cell"), F.lit(True).alias("home"), "unit")
    done = None
    for _ in range(LEVELS):
        sizes = cut(live.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
        if sizes.isEmpty():
            break
        dealt = cut(_dealt(live, sizes, threshold))
        better = cut(dealt.groupBy("cell").agg(F.avg(F.size("children")).alias("times")).join(sizes, "cell").where(F.col("times") < F.ceil(F.col("n") / BLOCK)).select("cell"))
        rest = live.join(better, "cell", "left_anti").select("number", "cell", "home", "unit")
        done = rest if done is None else done.unionByName(rest)
        live = dealt.join(better, "cell").select("number", F.posexplode("children").alias("_place", "cell"), "unit").select("number", "cell", (F.col("_place") == 0).alias("home"), "unit")
        live = cut(live)
    return live if done is None else done.unionByName(live)


def prune(x: np.ndarray, rows: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of the candidates of some rows of x (nearest first), in step: take the nearest one left, then drop
    those that lie nearer to it, times alpha, than to the row. Tells which candidates are taken."""
    n, width = pool.shape
    near = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", x[rows], x[pool])))
    alive = pool != rows[:, None]
    taken = np.zeros((n, width), bool)
    for _ in range(min(degree, width)):
        first = alive.argmax(axis=1)
        left = np.nonzero(alive[np.arange(n), first])[0]
        if not len(left):
            break
        first = first[left]
        taken[left, first] = True
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", x[pool[left, first]], x[pool[left]])))
        alive[left] &= alpha * apart > near[left]
        alive[left, first] = False
    return taken


def build(x: np.ndarray) -> list[np.ndarray]:
    """The pruned graph over x: each vector's pruned neighbours, and of those that have it as theirs the nearest."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    x = x.astype(np.float32)  # the graph only leads; links are told in double precision
    width = min(POOL, n)
    far = np.random.default_rng(n).choice(n, min(FAR, n), replace=False)  # they give the graph its long edges
    ends: list[list[np.ndarray]] = [[], []]
    step = max(16, min(512, NUMBERS // ((width + len(far)) * x.shape[1])))
    for a in range(0, n, step):
        sim = x[a : a + step] @ x.T
        part = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        part = np.concatenate([part, np.tile(far, (len(part), 1))], axis=1)
        pool = np.take_along_axis(part, np.argsort(-np.take_along_axis(sim, part, axis=1), axis=1, kind="stable"), axis=1)
        row, at = np.nonzero(prune(x, np.arange(a, a + len(pool)), pool))
        ends[0].append(a + row)
        ends[1].append(pool[row, at])
    i, j = map(np.concatenate, ends)
    sim = np.einsum("nd,nd->n", x[i], x[j])
    order = np.lexsort((-sim, j))
    first = np.concatenate([[True], j[order][1:] != j[order][:-1]])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    back = order[rank < 2 * DEGREE]
    i, j = np.concatenate([i, j[back]]), np.concatenate([j, i[back]])
    edges = np.unique(i * n + j)
    return np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))


def _next(ptr: np.ndarray, adj: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of ``nodes`` in a row, and for each the place in ``nodes`` that it comes from."""
    count = ptr[nodes + 1] - ptr[nodes]
    at = np.repeat(ptr[nodes] - np.concatenate([[0], count.cumsum()[:-1]]), count) + np.arange(count.sum())
    return adj[at], np.repeat(np.arange(len(nodes)), count)


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows a and b of x, pair by pair."""
    step = max(1, NUMBERS // x.shape[1])
    return np.concatenate([np.zeros(0), *[np.einsum("nd,nd->n", x[a[k : k + step]], x[b[k : k + step]]) for k in range(0, len(a), step)]])


def range_search(x: np.ndarray, graph: list[np.ndarray], start: int, queries: np.ndarray, least: float, slack: float = 0.03) -> np.ndarray:
    """``hit[i, j]``: that member j was found with a cosine of ``least`` or more to query i.

    All queries go in step: greedy descent from ``start`` with a beam, then widening over all neighbours whose cosine
    is within ``slack`` of the range.
    """
    n, m = len(x), len(queries)
    ptr, adj = np.concatenate([[0], np.cumsum([len(g) for g in graph])]), np.concatenate([np.zeros(0, np.int64), *graph]).astype(np.int64)
    seen = np.zeros((m, n), bool)  # of which the cosine is known
    hit = np.zeros((m, n), bool)
    seen[:, start] = True
    row, ids, done = np.arange(m), np.full(m, start), np.zeros(m, bool)
    sims = _dots(x, queries, ids)
    hit[row, ids] = sims >= least
    front: list[tuple[np.ndarray, np.ndarray]] = [(row[sims >= least - slack], ids[sims >= least - slack])]

    def meet(r: np.ndarray, new: np.ndarray) -> np.ndarray:
        seen[r, new] = True
        s = _dots(x, queries[r], new)
        hit[r, new] = s >= least
        near = s >= least - slack
        front.append((r[near], new[near]))
        return s

    while not done.all():
        todo = np.nonzero(~done)[0]
        todo = todo[np.concatenate([[True], row[todo][1:] != row[todo][:-1]])]  # the best of each query
        done[todo] = True
        new, of = _next(ptr, adj, ids[todo])
        r = row[todo][of]
        fresh = ~seen[r, new]
        r, new = r[fresh], new[fresh]
        s = meet(r, new)
        row, ids, sims, done = np.concatenate([row, r]), np.concatenate([ids, new]), np.concatenate([sims, s]), np.concatenate([done, np.zeros(len(r), bool)])
        order = np.lexsort((-sims, row))
        row, ids, sims, done = row[order], ids[order], sims[order], done[order]
        first = np.concatenate([[True], row[1:] != row[:-1]])
        keep = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) < BEAM
        row, ids, sims, done = row[keep], ids[keep], sims[keep], done[keep]
    while front:
        r, at = front.pop()
        for a in range(0, len(at), 20_000):
            new, of = _next(ptr, adj, at[a : a + 20_000])
            key = np.unique(r[a : a + 20_000][of] * n + new)
            key = key[~seen[key // n, key % n]]
            if len(key):
                meet(key // n, key % n)
    return hit


_TASK = "task_key long, block long, cell long, number long, copies long, home boolean, cells array<long>, homes array<boolean>, unit binary"


def _in_blocks(placed: DataFrame, members: DataFrame) -> DataFrame:
    """Each member once per cell; in cells of more than BLOCK members, once per pair of blocks of its own."""
    size = cut(placed.groupBy("cell").agg(F.count("*").alias("n")))
    own = placed.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("cell", "home"))).alias("_c"))  # one vector's cells
    d = placed.join(size, "cell").join(own.join(members.select("number", "copies"), "number"), "number")
    d = d.withColumn("cells", F.col("_c.cell")).withColumn("homes", F.col("_c.home"))
    d = d.withColumn("_b", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("number"), F.col("_b")))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    d = d.withColumn("task_key", F.xxhash64("cell", F.least("block", "_o"), F.greatest("block", "_o")))
    return d.select(*[c.split()[0] for c in _TASK.split(", ")])


def _graphs(rows: DataFrame) -> DataFrame:
    """``number, near``: the pruned neighbours of each member within its task, as numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task_key"):
            t = t.sort_by("number")
            ids = t.column("number").to_numpy()
            x = np.array([np.frombuffer(r) for r in t.column("unit").to_pylist()])
            near = [ids[g].tolist() for g in build(x)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near, pa.list_(pa.int64()))], names=["number", "near"])

    return rows.select("task_key", "number", "unit").repartition("task_key").sortWithinPartitions("task_key").mapInArrow(task, "number long, near array<long>")


def _search(rows: DataFrame, threshold: float) -> DataFrame:
    """Range searches of the members at home over the united graph of each task, verified in double precision.

    A pair may meet in several cells where one of it is at home: the lowest of them tells it. A pair of one block is
    told by that block's own task. Gives ``a, n`` rows with the links of each member and ``a, b`` rows with spanning
    links, and the audit's counts.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task_key"):
            t = t.sort_by("number")
            ids, block, copies = (t.column(c).to_numpy() for c in ("number", "block", "copies"))
            cell, home = t.column("cell")[0].as_py(), np.array(t.column("home").to_pylist())
            x = np.array([np.frombuffer(r) for r in t.column("unit").to_pylist()])
            n = len(ids)
            near = t.column("near").combine_chunks()
            lengths = near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            want = near.flatten().to_numpy()
            at = np.minimum(np.searchsorted(ids, want), n - 1)
            there = ids[at] == want
            edges = np.unique(np.repeat(np.arange(n), lengths)[there] * n + at[there])
            graph = np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))
            start = int((x @ x.mean(axis=0)).argmax())
            asked = np.nonzero(home)[0]
            link = np.zeros((n, n), bool)
            for a in range(0, len(asked), STEP):
                link[asked[a : a + STEP]] = range_search(x, graph, start, asked[a : a + STEP], threshold)
            np.fill_diagonal(link, False)  # a member always finds itself
            # audited until enough links were seen to tell the recall; where there are fewer, all queries are
            line, audited, share, hits, total = np.concatenate([asked[k::AUDIT] for k in range(AUDIT)]), 0, max(1, len(asked[::AUDIT])), 0, 0
            while audited < len(line) and total < SEEN:
                for a in range(audited, min(audited + share, len(line)), STEP):
                    part = line[a : min(a + STEP, audited + share)]
                    truth = x[part] @ x.T >= threshold
                    truth[np.arange(len(part)), part] = False
                    hits, total = hits + int((truth & link[part]).sum()), total + int(truth.sum())
                    link[part] = truth
                audited, share = audited + share, 2 * share
            if hits < RECALL * total:  # the exact way
                for a in range(0, len(asked), STEP):
                    link[asked[a : a + STEP]] = x[asked[a : a + STEP]] @ x.T >= threshold
                np.fill_diagonal(link, False)
            link |= link.T
            if block.min() != block.max():
                link &= block[:, None] != block[None, :]
            sets = [dict(zip(c, h, strict=True)) for c, h in zip(t.column("cells").to_pylist(), t.column("homes").to_pylist(), strict=True)]
            names: dict[tuple, int] = {}
            kind = np.array([names.setdefault(tuple(s.items()), len(names)) for s in sets])
            shared = np.array([len(s) > 1 for s in sets])
            if shared.any():  # pairs of equal cells are told alike
                alike = list(map(dict, names))
                for a in range(0, n, STEP):  # a dense cell has millions of links
                    i, j = np.nonzero(link[a : a + STEP] & shared[a : a + STEP, None] & shared[None, :])
                    pair, of = np.unique(kind[a + i] * len(alike) + kind[j], return_inverse=True)
                    told = [min(c for c, h in alike[k // len(alike)].items() if c in alike[k % len(alike)] and (h or alike[k % len(alike)][c])) == cell for k in pair.tolist()]
                    link[a + i, j] = np.array(told, bool)[of]
            links = np.concatenate([link[a : a + STEP] @ copies for a in range(0, n, STEP)])  # in parts: a product widens the flags to numbers
            some = np.nonzero(links)[0]
            sub = link[np.ix_(some, some)]
            ends = some[np.array(forest(len(some), lambda a, b: sub[np.ix_(a, b)], 512), dtype=np.int64).reshape(-1, 2)]  # noqa: B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[some], ids[ends[:, 0]], [0]])),
                    pa.array([None] * len(some) + ids[ends[:, 1]].tolist() + [None], pa.int64()),
                    pa.array(np.concatenate([links[some], np.zeros(len(ends) + 1, np.int64)])),
                    pa.array([None] * (len(some) + len(ends)) + [hits], pa.int64()),
                    pa.array([None] * (len(some) + len(ends)) + [total], pa.int64()),
                ],
                names=["a", "b", "n", "audit_found", "audit_total"],
            )

    return rows.repartition("task_key").sortWithinPartitions("task_key").mapInArrow(task, "a long, b long, n long, audit_found long, audit_total long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, audit: list | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding, label)``.

    Links join vectors of equal, not null labels and of cosine ``threshold`` or more. Null, zero and non-finite
    vectors, and rows without an id, link with nothing and are their own component. Equal vectors of a label are
    compared once and count as copies of each other; repeated rows are copies too. Vectors of any length link only with
    those of their length. An empty table gives no rows; other columns are not read. ``audit`` receives the found and
    true links of the audited queries before any cell is searched whole, if a list is given; the log has them always.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = cut(_usable(vectors.where(F.col("vec_id").isNotNull())))
    members = usable.groupBy("label", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    members = cut(members.withColumn("number", F.xxhash64("label", "unit")))
    rows = cut(_in_blocks(cut(cells(members, threshold)), members))
    near = _graphs(rows).groupBy("number").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a vector's cells, of DEGREE each
    found = cut(_search(rows.join(near, "number"), threshold))
    r = found.agg(F.coalesce(F.sum("audit_found"), F.lit(0)), F.coalesce(F.sum("audit_total"), F.lit(0))).first()
    log.info("graph search found %d of %d audited links", *r)
    if audit is not None:
        audit += list(r)
    links = found.where("audit_total is null")
    classes = components(links.where("b is not null").select("a", "b"))
    count = links.where("b is null").groupBy(F.col("a").alias("number")).agg(F.sum("n").alias("n"))
    named = members.join(classes.withColumnRenamed("node", "number"), "number", "left").join(count, "number", "left").withColumn("root", F.coalesce("root", "number"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    told = named.join(least, "root").select("label", "unit", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    linked = usable.join(told, ["label", "unit"]).groupBy("vec_id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    out = vectors.select("vec_id").join(linked, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
