"""Operator 11: benchmark decontamination by a generalised suffix automaton of the items' words.

An item's windows are all its runs of ``length`` words, or of the ``coverage`` share of its words where that is less (an
item of fewer words is one window of its own). The automaton holds every run of words of every item; a text's words are
streamed through it, and the longest run that ends at a word is tracked. Where that run reaches a window's length, the
states on its suffix path name the windows that end there.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import cut, slices

#: Words of a window, and the share of an item's words that is a window if it is shorter.
LENGTH, COVERAGE = 10, 1.0
#: A text of which more than this share of the words is hit is dropped by :func:`decontaminate`.
MOST = 0.5
#: Words of one automaton, which bounds what is broadcast (some 20 MB); more items make more automata, each one a pass.
PART = 200_000
#: Words of an item that are kept together; longer items go in pieces that overlap by a window.
PIECE = 10_000
#: Bytes of a text whose words are looked up at once.
BLOCK = 1 << 20

#: What each byte of a UTF-8 text becomes: letters and digits and all that is not ASCII stay, A-Z in lower case, others part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def window(words: int, length: int = LENGTH, coverage: float = COVERAGE) -> int:
    """The length of the windows of an item of some words."""
    return max(1, min(length, math.ceil(coverage * words - 1e-9)))


def _slot(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """A place for a pair of words in a table of ``2 ** bits`` places."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class Builder:
    """A generalised suffix automaton while items are added: per state its steps, its suffix link and its longest run."""

    def __init__(self) -> None:
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.depth = [-1], [0]

    def _state(self, depth: int, link: int, steps: dict[int, int]) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.depth.append(depth)
        return len(self.link) - 1

    def _split(self, last: int, word: int, old: int) -> int:
        """A state for the runs of ``old`` that are no longer than those of ``last`` and the word."""
        new = self._state(self.depth[last] + 1, self.link[old], dict(self.steps[old]))
        self.link[old] = new
        while last >= 0 and self.steps[last].get(word) == old:
            self.steps[last][word] = new
            last = self.link[last]
        return new

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            old = self.steps[last].get(word)
            if old is not None:
                last = old if self.depth[old] == self.depth[last] + 1 else self._split(last, word, old)
                continue
            new, at = self._state(self.depth[last] + 1, 0, {}), last
            while at >= 0 and word not in self.steps[at]:
                self.steps[at][word] = new
                at = self.link[at]
            if at >= 0:
                old = self.steps[at][word]
                self.link[new] = old if self.depth[old] == self.depth[at] + 1 else self._split(at, word, old)
            last = new

    def ends(self, words: list[int], size: int) -> Iterator[int]:
        """The state of each run of ``size`` words of an item that was added."""
        state = 0
        for i, word in enumerate(words):
            state = self.steps[state][word]
            while self.depth[self.link[state]] >= size:
                state = self.link[state]
            if i >= size - 1:
                yield state


def build(items: list[tuple[str | None, int, list[bytes]]]) -> dict:
    """The packed automaton of ``(item, words of a window, words)``."""
    vocabulary: dict[bytes, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in words] for _, _, words in items]
    made = Builder()
    for words in coded:
        made.add(words)
    marks: dict[int, dict[int, set[str]]] = {}
    for (item, size, _), words in zip(items, coded, strict=True):
        for state in made.ends(words, size):
            marks.setdefault(state, {}).setdefault(size, set()).update(() if item is None else (item,))
    above = [0] * len(made.link)
    for state in sorted(range(1, len(made.link)), key=made.depth.__getitem__):
        up = made.link[state]
        above[state] = up if up in marks else above[up]
    pairs = np.array([p for words in coded for p in zip(words, words[1:])], np.int64).reshape(-1, 2)
    bits = max(10, (32 * len(pairs)).bit_length())
    return {
        "words": list(vocabulary),
        "least": min((size for _, size, _ in items), default=1),
        "steps": np.array([(s << 32 | w, t) for s, own in enumerate(made.steps) for w, t in own.items()], np.int64).reshape(-1, 2),
        "link": np.array(made.link, np.int32),
        "depth": np.array(made.depth, np.int32),
        "above": np.array(above, np.int32),
        "marks": {s: tuple((size, tuple(sorted(found))) for size, found in sorted(own.items())) for s, own in marks.items()},
        "pairs": np.unique(_slot(pairs[:, 0], pairs[:, 1], bits)),
        "bits": bits,
    }


class Matcher:
    """A packed automaton made ready to stream words through."""

    def __init__(self, packed: dict) -> None:
        self.vocabulary = {w: i for i, w in enumerate(packed["words"])}
        self.steps = dict(packed["steps"].tolist())
        self.link, self.depth, self.above = (packed[k].tolist() for k in ("link", "depth", "above"))
        self.marks, self.least, self.bits = packed["marks"], packed["least"], packed["bits"]
        self.table = np.zeros(1 << self.bits, bool)
        self.table[packed["pairs"]] = True

    def codes(self, text: bytes) -> np.ndarray:
        """The words of a text as numbers, -1 for those of no item; a long text goes in blocks."""
        parts, at = [], 0
        text = text.translate(_FOLD)
        while at < len(text):
            end = text.find(b" ", at + BLOCK)
            words = text[at : end if end >= 0 else len(text)].split()
            parts.append(np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words)))
            at = end if end >= 0 else len(text)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])

    def runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """The places in which a window can lie: runs of words all of whose neighbours may be neighbours in an item."""
        if len(codes) < self.least:
            return
        a, b = codes[:-1], codes[1:]
        breaks = np.flatnonzero((a < 0) | (b < 0) | ~self.table[_slot(a, b, self.bits)]) + 1
        starts, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(codes)]])
        wanted = (ends - starts >= self.least) & (codes[starts] >= 0)
        yield from zip(starts[wanted].tolist(), ends[wanted].tolist())

    def find(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit places of a text's words as disjoint ``(start, end)`` in order, and the items with windows there."""
        spans: list[list[int]] = []
        seen: set[tuple[int, int]] = set()
        steps, link, depth, above, marks = self.steps, self.link, self.depth, self.above, self.marks
        for start, end in self.runs(codes):
            state = longest = 0
            for at, word in enumerate(codes[start:end].tolist(), start + 1):
                go = steps.get(state << 32 | word)
                while go is None and state:
                    state = link[state]
                    longest = depth[state]
                    go = steps.get(state << 32 | word)
                if go is None:
                    longest = 0
                    continue
                state, longest = go, longest + 1
                if longest < self.least:
                    continue
                covered, here = 0, state
                while here:
                    for size, _ in marks.get(here, ()):
                        if size <= longest:
                            seen.add((here, size))
                            covered = max(covered, size)
                    here = above[here]
                if covered:
                    if spans and at - covered <= spans[-1][1]:  # windows end in order but may begin before the last one
                        first = at - covered
                        while len(spans) > 1 and first <= spans[-2][1]:
                            spans.pop()
                        spans[-1] = [min(first, spans[-1][0]), at]
                    else:
                        spans.append([at - covered, at])
        return [(a, b) for a, b in spans], {item for state, size in seen for own, found in marks[state] if own == size for item in found}


_matchers: dict = {}


def _matcher(name: str, holder) -> Matcher:
    """The worker's matcher of a call and part, by its own name; one is held at a time."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(pickle.loads(holder.value))
    return _matchers[name]


def _parts(items: DataFrame, length: int, coverage: float, part: int) -> tuple[DataFrame, int]:
    """``part, packed``: the automata of the items, each of about ``part`` words and built in a task of its own."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py() or b"")
                size = window(len(words), length, coverage)
                for k, a in enumerate(range(0, max(0, len(words) - size + 1), PIECE)):
                    own = words[a : a + PIECE + size - 1]
                    for col, value in zip(cols, (item, size, len(own), b" ".join(own)), strict=True):
                        col.append(value)
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "size", "n", "words"])

    def packed(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("item", "size", "words")), strict=True), key=lambda r: (r[2], r[0] or ""))
        made = pickle.dumps(build([(item, size, words.split()) for item, size, words in rows]), 5)
        return pa.table({"part": group.column("part")[:1], "packed": pa.array([made], pa.binary())})

    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    rows = cut(rows.mapInArrow(pieces, "item string, size int, n long, words binary").dropDuplicates(["item", "size", "words"]))
    n = -(-(rows.agg(F.sum("n")).first()[0] or 0) // part)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(max(n, 1))).cast("int"))
    return cut(dealt.groupBy("part").applyInArrow(packed, "part int, packed binary")), n


def find(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, length: int = LENGTH, coverage: float = COVERAGE, part: int = PART) -> DataFrame:
    """The columns of ``docs`` named in ``keep`` (the id if None), each row with what of its text is in items:
    ``n_words``, ``hits`` (disjoint places of hit words, as ``start, end`` in words) and ``hit_items`` in string order.

    ``items (item_id, text)``. Null texts have no words and empty items no windows; an item without an id hits words but
    is not named; rows of one id are one item. Every row of ``docs`` gives one row, repeated rows equal ones; without
    items nothing is hit; an empty table gives no rows. A text of any length is read whole.

    Nothing is shuffled but the items. Items of over ``part`` words make several automata of bounded size; each is
    broadcast in turn and gets a pass of the texts, between which rows are cut to a checkpoint.
    """
    keep = ["doc_id"] if keep is None else keep
    automata, n = _parts(items, length, coverage, part)
    names = [f"c{i}" for i in range(len(keep))]
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col("text").cast("binary").alias("t"))
    found = "n_words long, hits array<struct<start:long,end:long>>, hit_items array<string>"
    rows = plain.select("*", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("hit_items"))
    sc, call = docs.sparkSession.sparkContext, uuid.uuid4().hex
    for p in range(max(n, 1)):
        got = automata.where(F.col("part") == p).first()
        holder = sc.broadcast(got.packed if got else pickle.dumps(build([]), 5))
        last = p >= n - 1

        def task(batches: Iterator[pa.RecordBatch], name: str = f"{call}-{p}", holder=holder, last: bool = last) -> Iterator[pa.RecordBatch]:
            own = _matcher(name, holder)
            for batch in slices(batches):
                at = len(names)
                counts, hits, hit_items = [], [], []
                for text, before, others in zip(batch.column(at), batch.column(at + 2).to_pylist(), batch.column(at + 3).to_pylist(), strict=True):
                    codes = own.codes(text.as_py() or b"")
                    spans, found = own.find(codes)
                    counts.append(len(codes))
                    hits.append([{"start": a, "end": b} for a, b in united(spans, [(s["start"], s["end"]) for s in before])])
                    hit_items.append(sorted(found.union(others)))
                kept = batch.columns[: at if last else at + 1]
                spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                new = [pa.array(counts, pa.int64()), pa.array(hits, spans_type), pa.array(hit_items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*(names if last else [*names, "t"]), "n_words", "hits", "hit_items"])

        fields = [f"{k} {plain.schema[k].dataType.simpleString()}" for k in names] + ([] if last else ["t binary"])
        rows = rows.mapInArrow(task, ", ".join([*fields, found]))
        rows = rows if last else cut(rows)
    return rows.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "n_words", "hits", "hit_items")


def united(spans: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of two lists as disjoint ones in order; those that touch become one."""
    if not more:
        return spans
    out: list[list[int]] = []
    for a, b in sorted([*spans, *more]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, coverage: float = COVERAGE, part: int = PART) -> DataFrame:
    """The contract's columns from :func:`find`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    d = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, None, length, coverage, part)
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text whose words in ``spans`` are gone, with what stands between them; a line break stands for each span."""
    inside = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for a, b in spans:
        out += [text[at : starts[a]], b"\n"]
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, length: int = LENGTH, coverage: float = COVERAGE, most: float = MOST, part: int = PART) -> DataFrame:
    """``docs``, all columns, without the spans that :func:`find` hits; rows with more than ``most`` of the words hit go.

    What a removed span stood between may make a window in turn, so rows that were changed are searched again until
    none is hit. Rows without a hit, null texts among them, stay as they are; repeated rows stay equal.
    """
    names = docs.columns
    at = names.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[(s["start"], s["end"]) for s in row] for row in batch.column(len(names)).to_pylist()]
            texts = [without(t.as_py().encode(), own).decode() for t, own in zip(batch.column(at), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))], names=names)

    share = lambda d: F.aggregate("_hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]) > most * F.col("_n")
    done, rows = None, docs
    while True:
        found = find(rows, items, names, length, coverage, part)
        found = cut(found.toDF(*names, "_n", "_hits", "_items"))
        clean = found.where(F.size("_hits") == 0).select(*[f"`{c}`" for c in names])
        done = clean if done is None else done.unionByName(clean)
        hit = found.where((F.size("_hits") > 0) & ~share(found)).select(*[f"`{c}`" for c in names], "_hits")
        if hit.isEmpty():
            return done
        rows = cut(hit.mapInArrow(task, docs.schema))


def _sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, {words} w FROM documents),
b AS (SELECT item_id::VARCHAR item, {words} w FROM benchmark),
sized AS (SELECT item, w, least({LENGTH}, len(w)) k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) i FROM sized)),
seen AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') s
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT rid, k, i, item FROM seen JOIN win USING (k, s)),
places AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(range(i, i + k)) p FROM (SELECT DISTINCT rid, i, k FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) n, string_agg(DISTINCT item, ',' ORDER BY item) s FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(places.n, 0) n_hit, coalesce(items.n, 0) n_items, sha256(coalesce(items.s, '')) items_sha256, places.n IS NOT NULL contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""


ORACLE = _sql()
