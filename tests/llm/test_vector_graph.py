from __future__ import annotations

import numpy as np
import pytest

from folium.llm import vector_graph as vg


def rows():
    rng = np.random.default_rng(2)
    out = []
    for label in (0, 1, 2):
        for _ in range(40):
            base = rng.normal(size=16)
            out += [((base + 0.04 * rng.normal(size=16)).tolist(), label) for _ in range(rng.integers(1, 6))]
    blob = rng.normal(size=16)
    out += [((blob + 0.03 * rng.normal(size=16)).tolist(), 5) for _ in range(80)]
    out += [(out[3][0], out[3][1]), (out[4][0], 1), (out[4][0], None), (None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] + [1.0] * 15, 1), ([1.0, 2.0], 1), ([1.0, 2.01], 1), ([], 1)]
    return [(100 + i, v, k) for i, (v, k) in enumerate(out)] + [(100, out[0][0], out[0][1]), (None, out[0][0], out[0][1])]


def brute(data):
    units = [vg.unit(v) if k is not None and i is not None else None for i, v, k in data]
    n = len(data)
    link = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and data[i][2] == data[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.98] for i in range(n)]
    out = []
    for i, (d, _, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((data[j][0] for j in seen if data[j][0] is not None), default=None)
        out.append((d, len(link[i]), least, True if d is None else least == d))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell,block", [(2000, 5000), (25, 30)])
def test_equals_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vg, "CELL", cell)
    monkeypatch.setattr(vg, "BLOCK", block)
    docs = spark.createDataFrame([(i, v, k, "x", 0) for i, v, k in rows()], "vec_id long, embedding array<float>, label int, unit string, cell int")
    data = [(r.vec_id, r.embedding, r.label) for r in docs.collect()]
    audit: list = []
    got = sorted([tuple(r) for r in vg.near_duplicates(docs, audit=audit).collect()], key=str)
    want = brute(data)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(min(g[1], w[1]) for g, w in zip(got, want, strict=True)) >= 0.97 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and got == want or cell == 25
    assert audit[0] >= 0.9 * audit[1] > 0
    assert vg.near_duplicates(docs.limit(0)).collect() == []


def test_search_finds_nearly_all():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 32)).repeat(20, axis=0) + 0.1 * rng.normal(size=(1200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vg.build(x)
    asked = np.arange(0, 1200, 7)
    hit, truth = vg.range_search(x, graph, 0, asked, 0.98), x[asked] @ x.T >= 0.98
    assert (hit & truth).sum() >= 0.95 * truth.sum() and not (hit & ~truth).any()
    assert sum(map(len, graph)) <= 3 * vg.DEGREE * len(x)


def test_links_across_borders_share_a_cell():
    rng = np.random.default_rng(4)
    flat = rng.uniform(0, 2 * np.pi, 500)  # vectors that vary in two of 64 directions
    x, c = np.zeros((500, 64)), np.zeros((12, 64))
    at = np.arange(12) * 2 * np.pi / 12
    x[:, 0], x[:, 1], c[:, 0], c[:, 1] = np.cos(flat), np.sin(flat), np.cos(at), np.sin(at)
    own, inside = vg.places(x, c, 0.98)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert len(a) > 1000 and all(inside[i, own[j]] or inside[j, own[i]] for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert inside.sum(axis=1).max() < 4


def test_recall_over_many_clustered_vectors(spark, monkeypatch):
    """12,000 vectors of one label in two rounds of cells, against all pairs in blocks."""
    monkeypatch.setattr(vg, "CELL", 600)
    monkeypatch.setattr(vg, "BLOCK", 1500)
    rng = np.random.default_rng(7)
    tops = rng.normal(size=(12, 48))
    x = (tops[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 48))).repeat(4, axis=0)
    x = (x + 0.02 * rng.choice([1, 2, 4, 8], size=(len(x), 1)) * rng.normal(size=x.shape)).astype(np.float32)
    audit: list = []
    docs = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vg.near_duplicates(docs, audit=audit).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = np.concatenate([(u[a : a + 2000] @ u.T >= 0.98).sum(axis=1) - 1 for a in range(0, len(u), 2000)])
    found = np.array([got[i].n_links for i in range(len(u))])
    assert true.sum() > 5000 and (found <= true).all() and found.sum() >= 0.95 * true.sum() and audit[1] > 0


def test_labels_of_text(spark):
    data = [(i, v, None if k is None else f"kind {k}") for i, v, k in rows()]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<float>, label string")
    data = [(r.vec_id, r.embedding, r.label) for r in docs.collect()]
    assert sorted([tuple(r) for r in vg.near_duplicates(docs).collect()], key=str) == brute(data)


@pytest.mark.parametrize("blind", [False, True])
def test_sparse_cells_are_audited_until_links_were_seen(spark, blind):
    """Few links among many vectors: none may be lost even where the graph search finds nothing at all."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 48))
    pairs = rng.choice(1500, (15, 2), replace=False)
    for a, b in pairs:
        x[b] = x[a] + 0.02 * rng.normal(size=48)
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    placed = docs.transform(lambda d: vg.cut(vg._usable(d)))
    members = vg.cut(placed.groupBy("label", "unit").agg(vg.F.min("vec_id").alias("least"), vg.F.count("*").alias("copies")).withColumn("number", vg.F.xxhash64("label", "unit")))
    cells = vg.cut(vg._in_blocks(vg.cut(vg.cells(members, 0.98)), members))
    none = cells.select("number").distinct().withColumn("near", vg.F.array().cast("array<long>"))  # a graph without edges finds next to nothing
    graph = none if blind else vg._graphs(cells).groupBy("number").agg(vg.F.array_distinct(vg.F.flatten(vg.F.collect_list("near"))).alias("near"))
    found = vg._search(cells.join(graph, "number"), 0.98)
    links = found.where("audit_total IS NULL AND b IS NULL").agg(vg.F.sum("n")).first()[0]
    assert links == 2 * len(pairs)
