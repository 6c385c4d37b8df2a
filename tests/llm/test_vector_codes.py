from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from folium.llm import vector_codes as op

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code int, salt string"


def plain(rows, parts=16, entries=64, rounds=2):
    """All distances in Python's integers."""
    kept = [(i, [math.floor(256 * Fraction(x)) for x in v], lab, v) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    least = min((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[3]), default=None)
    if least is None:
        return []
    kept = [r for r in kept if len(r[1]) == len(least[1])]
    m = len(least[1]) // parts
    cut = lambda v: [v[p * m : (p + 1) * m] for p in range(parts)]
    by_id = {}
    for i, v, _, real in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[3])):
        by_id.setdefault(i, v)
    books = [list(b) for b in zip(*(cut(by_id[i]) for i in sorted(by_id)[:entries]))]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))

    for _ in range(rounds):
        got = [defaultdict(list) for _ in range(parts)]
        for _, v, _, _ in kept:
            for p, x in enumerate(cut(v)):
                got[p][near(books[p], x)[1]].append(x)
        for p in range(parts):
            for k, xs in got[p].items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    coded = [(i, lab, [near(books[p], x) for p, x in enumerate(cut(v))]) for i, v, lab, _ in kept]
    total = defaultdict(int)
    for _, lab, found in coded:
        total[lab] += sum(d for d, _ in found)
    long = lambda n: n if n < 1 << 63 else None
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), long(sum(d for d, _ in found)), long(total[lab]), sha) for i, lab, found in coded), key=str)


def cases(kind):
    rng = random.Random(7)
    n, width = 150, 32
    if kind == "ties":  # few values, so that many entries are equally near
        make = lambda: [rng.choice([-0.5, 0.0, 0.25]) / 64 for _ in range(width)]
    elif kind == "huge":
        make = lambda: [rng.choice([1e300, -3e20, 0.1, -0.1, 1.7e308, 5e-324, 2.0**41 + 0.25]) for _ in range(width)]
    else:
        make = lambda: [rng.gauss(0, 0.2) for _ in range(width)]
    rows = [(rng.randrange(400), make(), rng.choice([0, 1, 2, None])) for _ in range(n)]
    if kind == "few":
        rows = rows[:9]
    rows += rows[:5] + [(rows[0][0], make(), 1), (None, make(), 2), (0, None, 1), (0, [], 1), (0, [None] * width, 1), (0, [math.nan] * width, 0), (0, [math.inf] + [0.0] * (width - 1), 0), (401, [0.1] * 48, 1), (0, [0.1] * 17, 1)]
    return rows


@pytest.mark.parametrize("kind", ["gauss", "ties", "huge", "few"])
def test_equals_plain_integers(spark, kind):
    rows = cases(kind)
    got = op.compressed(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty_table(spark):
    assert op.compressed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_label_of_text_and_decoding(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 32).astype(np.float32).tolist(), "abc"[i % 3]) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label string")
    books = op.codebooks(op.usable(d))
    got = op.decode(op.compressed(d), books).collect()
    assert len(got) == 200
    by_id = {i: v for i, v, _ in rows}
    for r in got:
        exact = np.floor(np.array(by_id[r.vec_id]) * 256)
        assert int(((exact - np.array(r.approx) * 256) ** 2).sum()) == r.error


@pytest.mark.parametrize("width", [1, 3, 4, 7, 16])
def test_bounds_leave_no_nearest_entry_out(width):
    rng = np.random.default_rng(width)
    for spread in (2, 60, 1 << 20):
        book = op.Codebook(rng.integers(-spread, spread, (64, width)))
        x = np.concatenate([rng.integers(-spread, spread, (300, width)), book.entries[::5]])
        code, error = book.nearest(x)
        all_of_them = ((x[:, None, :] - book.entries) ** 2).sum(axis=2)
        assert (code == all_of_them.argmin(axis=1)).all() and (error == all_of_them.min(axis=1)).all()
        assert spread < 60 or len(book._survivors(x)[0]) < len(x) * 64  # and they do save work
