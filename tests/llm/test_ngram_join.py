from __future__ import annotations

import random

import numpy as np
import pytest

from folium.llm import ngram_join as nj


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = [None, "", "  \n", "one two", "ONE  two", "one two three four five", "clean unrelated words that stand alone here"]
    common = " ".join(word() for _ in range(30))
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(60, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 8)):
            near = list(base)
            for _ in range(rng.randrange(0, 9)):
                near[rng.randrange(len(near))] = word()
            out.append(" ".join(near))
    out += [common + " " + " ".join(word() for _ in range(100)) for _ in range(40)]
    base = [word() for _ in range(100)]
    for i in range(90):  # one large group of near copies
        near = list(base)
        near[i % 100] = word()
        out.append(" ".join(near))
    return out


def brute(rows):
    sets = [set(nj.shingles(t).tolist()) for _, t in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and rows[i][0] is not None and rows[j][0] is not None and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and sets[j]] for i in range(n)]
    want = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        want.append((d, None if d is None else min(rows[j][0] for j in seen), len(link[i]), len(sets[i])))
    return sorted(want, key=str)


@pytest.mark.parametrize("leaf,block,shingles", [(2048, 2048, 2_000_000), (4, 24, 3000)])
def test_join_equals_brute_force(spark, monkeypatch, leaf, block, shingles):
    for name, value in (("LEAF", leaf), ("BLOCK", block), ("BLOCK_SHINGLES", shingles)):
        monkeypatch.setattr(nj, name, value)
    rows = [(100 + i, t) for i, t in enumerate(texts())]
    rows += [rows[8], rows[8], (None, rows[9][1]), (7, rows[12][1]), (7, "another text with the same number as the one before")]
    docs = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], "doc_id long, text string, rep string, node int, set_key string")
    got = sorted([tuple(r) for r in nj.ngram_join(docs).collect()], key=str)
    assert got == brute(rows)
    assert nj.ngram_join(docs.limit(0)).collect() == []


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    got = nj.overlaps(sets, 32)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


def test_paths_and_sketches_keep_the_target_recall():
    from math import comb

    s = nj.THRESHOLD[0] / nj.THRESHOLD[1]
    deep = nj.levels(nj.RUNS, nj.THRESHOLD)
    assert deep > 1 and (1 - s**deep) ** nj.RUNS <= 2e-5 < (1 - s ** (deep + 1)) ** nj.RUNS
    least = -(-nj.CANDIDATE * nj.COORDINATES // 1)
    assert sum(comb(nj.COORDINATES, i) * s**i * (1 - s) ** (nj.COORDINATES - i) for i in range(int(least))) <= 2e-6


def test_audit_tells_lost_links(spark):
    rows = [(100 + i, t) for i, t in enumerate(texts())] + [(None, "x")]
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    joined = nj.cut(nj.ngram_join(docs, keys=True))
    found, true = nj.audit(docs, joined, sample=100)
    assert found == true > 100
    want = {d: n for d, _, n, _ in brute(rows)}
    every, all_links = nj.audit(docs, joined, sample=10_000)
    first = {}
    for r in joined.where("set_key IS NOT NULL AND doc_id IS NOT NULL").collect():
        first[bytes(r.set_key)] = r.doc_id
    assert every == all_links == sum(want[d] for d in first.values())
    poor = joined.withColumn("n_links", nj.F.greatest(nj.F.col("n_links") - 1, nj.F.lit(0)))
    assert nj.audit(docs, poor, sample=10_000)[0] < all_links
    assert nj.audit(docs.limit(0), joined.limit(0)) == (0, 0)
