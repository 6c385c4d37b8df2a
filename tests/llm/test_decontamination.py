from __future__ import annotations

import hashlib
import math
import random
import re

import pytest

from folium.llm import decontamination as op

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, n_words string, hits int, item_id string, c0 string"
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, length=10, coverage=1.0):
    """Every window of every item looked for at every place."""
    windows = []
    for item, text in items:
        own = words(text)
        size = max(1, min(length, math.ceil(coverage * len(own) - 1e-9)))
        windows += [(item, tuple(own[i : i + size])) for i in range(len(own) - size + 1)]
    out = []
    for doc_id, text in docs:
        own, hit, named = words(text), set(), set()
        for item, w in set(windows):
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    named |= {str(item)} if item is not None else set()
        out.append((doc_id, len(own), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed, letters="abc", n_docs=60, longest=60):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(letters) + rng.choice([" ", ", ", "\n", ". "]) for _ in range(n))
    items = [(i, text(rng.randrange(14))) for i in range(12)] + [(3, text(11)), (None, text(12)), (40, None), (41, ""), (42, "?!"), (100, "Éa É9 ﬀ")]
    docs = [(i, text(rng.randrange(longest))) for i in range(n_docs)]
    docs += [(100 + i, f"{text(5)} {t or ''} {text(4)}".upper()) for i, (_, t) in enumerate(items)] + [(None, items[0][1]), (7, None), (8, ""), (8, ""), (9, "...")]
    return docs, items


@pytest.mark.parametrize(("letters", "length", "coverage", "part"), [("abcdefgh", 10, 1.0, 200_000), ("ab", 10, 1.0, 200_000), ("abc", 4, 0.5, 200_000), ("abcdé", 6, 0.75, 30)])
def test_equals_brute_force(spark, letters, length, coverage, part):
    docs, items = cases(len(letters) + part, letters)
    d = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    got = op.contamination(d, b, length, coverage, part)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, length, coverage)


def test_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 15)
    rng = random.Random(4)
    items = [(1, " ".join(rng.choice("abcdef") for _ in range(200)))]
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(30)) + " " + " ".join(items[0][1].split()[a : a + 25])) for i, a in enumerate(range(0, 175, 7))]
    got = op.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), part=50)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = cases(9)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert op.contamination(d.limit(0), b).collect() == []
    none = op.contamination(d, b.limit(0)).collect()
    assert sorted(map(tuple, none), key=str) == plain(docs, [])
    assert op.decontaminate(d.limit(0), b).collect() == []


def test_very_long_text_in_blocks(monkeypatch):
    rng = random.Random(2)
    item = [rng.choice([b"alpha", b"be", b"c", b"delta9"]) for _ in range(40)]
    text = [b"zzz"] * 3000 + item + [b"yyy", b"alpha", b"be"] * 4000 + item[5:20] + [b"q" * 5000]
    own = op.Matcher(op.build([("1", 10, item)]))
    whole = own.codes(b" ".join(text)).tolist()
    monkeypatch.setattr(op, "BLOCK", 64)
    assert own.codes(b" ".join(text)).tolist() == whole == [own.vocabulary.get(w, -1) for w in text]
    spans, found = own.find(own.codes(b" ".join(text)))
    assert found == {"1"} and (3000, 3040) in spans and spans[-1][1] == len(text) - 1


def test_automaton_has_every_run_and_no_other():
    rng = random.Random(1)
    items = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(8)]
    made = op.Builder()
    for own in items:
        made.add(own)
    runs = {tuple(own[i:j]) for own in items for i in range(len(own)) for j in range(i + 1, len(own) + 1)}

    def walk(run):
        state = 0
        for w in run:
            state = made.steps[state].get(w)
            if state is None:
                return False
        return made.depth[made.link[state]] < len(run) <= made.depth[state]

    assert all(map(walk, runs))
    for _ in range(500):
        run = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 8)))
        assert walk(run) == (run in runs)


def test_spans_go_and_full_texts_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, f"Before it, {item.upper()}! After; it is all here and there is a lot more text than was hit by that.", "a"),
        (2, item, "b"),
        (3, None, "c"),
        (4, "clean as ever", "d"),
        # what stands round a removed span makes a window of its own
        (5, "é x x x x x x x x x x x x x x x x x x x x x x x x one two three four " + item + " five six seven eight nine ten y", "e"),
    ]
    got = {r[0]: r for r in op.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, hits string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[3].text is None and got[4].text == "clean as ever"
    assert got[1].text == "Before it, \n! After; it is all here and there is a lot more text than was hit by that." and got[1].hits == "a"
    assert words(got[5].text) == ["é", *["x"] * 24, "y"]
