from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from folium.llm import conversations as op

SCHEMA = "conv_id long, turn long, role string, text string, gaps string, c int, audit string"


@pytest.fixture(params=["whole", "pieces"])
def parts(spark, request):
    """Partitions that hold many conversations, and small ones that cut through them."""
    conf = {"spark.sql.shuffle.partitions": "4" if request.param == "whole" else "9", "spark.sql.adaptive.coalescePartitions.enabled": str(request.param == "whole").lower()}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def searched(turns):
    """The cheapest and least string of edits by a search from the front, cheapest first, over whole strings."""
    to = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        if audit.count("I") < 2 * len(turns) + 3:
            heapq.heappush(heap, (cost + 2, audit + "I", i, to[state][1]))
        if i < len(turns):
            initial, must_go, late = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not must_go:
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, to[state][1]))
                if (state, initial) in keep:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, keep[state, initial]))
    return None


def plain(rows):
    """Rows after damage, as ``(conv_id, turn, role, text)``, to results by conversation."""
    out = []
    for c in {r[0] for r in rows}:
        own = sorted((r[1:4] for r in rows if r[0] == c and not r[4]), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, turns, n = set(), [], [0, 0, 0]
        for _, role, text in own:
            inner = re.sub("[\x20\x09-\x0d]+$", "", text)
            which = 0 if not inner else 1 if (role, text) in seen else 2 if inner[-1] not in ".!?" else 3
            seen.add((role, text))
            if which < 3:
                n[which] += 1
            turns.append((role[:1], which < 2, which == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = searched(turns)
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter != "I":
                role, text, at = own[at][1], own[at][2], at + 1
            if letter == "D":
                continue
            wanted = "assistant" if state == 2 else "user"
            role, text = (role, text) if letter == "K" else (wanted, "" if letter == "I" else text)
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((c, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines))
    return sorted(out, key=str)


def cases(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes", "No!", "why?\n", "", " \t\x0b", " ", "Wait. ", "x.\ny", "ok.", "Très bien.", ". "]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", "usher"]
    rows = []
    for c in range(25):
        for t in range(rng.randrange(7)):
            rows.append((c, rng.choice([t, t, t + 2, None]), rng.choice([*roles, None]), rng.choice([*texts, None])))
    rows += [(77, t // 2, roles[t % 5], rng.choice(texts) + str(t % 40)) for t in range(160)]  # one of many turns, ties and repeated rows
    rows += [(78, 1, "user", "Same again.")] * 90 + [(None, t, "user", f"{t}.") for t in range(5)] + [(79, None, None, None)]
    return rows


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def test_equals_search(spark, parts):
    rows = [(c, t, r if r is not None else " ", x if x is not None else " ", False) for c, t, r, x in cases()]
    want = plain(rows)
    got = op.repair(rows_of(spark, cases()))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == [w[:-1] for w in want]
    turns = sorted(map(tuple, op.repaired(rows_of(spark, cases())).collect()), key=lambda r: (str(r[0]), r[1]))
    assert turns == sorted(((w[0], i, *line.split(":", 1)) for w in want for i, line in enumerate(w[-1])), key=lambda r: (str(r[0]), r[1]))


def test_damage(spark, parts):
    rows = cases(8) + [(500 + i, t, "assistant", f"Hm? {t}. No!") for i in range(60) for t in range(1 + i % 2)]
    hurt = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        hurt += [(c, t, "user" if fate == 4 else role, text, fate == 0)] * (2 if fate == 3 else 1)
    assert any(all(h[4] for h in hurt if h[0] == r[0]) for r in rows)  # one of which nothing is left
    got = sorted(map(tuple, op.repair(op.damaged(rows_of(spark, rows))).collect()), key=str)
    assert got == [w[:-1] for w in plain(hurt)]


def test_empty_table(spark):
    none = rows_of(spark, cases()[:1]).limit(0)
    assert op.repair(op.damaged(none)).collect() == [] and op.repaired(none).collect() == []


def test_ids_of_text_and_long_texts(spark):
    rows = [("b", 1, "user", "é" * 3_000_000 + "."), ("b", 2, "assistant", "no end"), ("a", 2, "assistant", "No."), ("a", 1, "user", "Yes?")]
    got = {r.conv_id: r for r in op.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert (got["a"].audit, got["a"].cost, got["b"].audit, got["b"].cost) == ("KK", 0, "KK", 1)
    assert got["b"].repaired_sha256 == hashlib.sha256(("user:" + "é" * 3_000_000 + ".\nassistant:no end").encode()).hexdigest()
