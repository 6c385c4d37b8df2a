"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.shared import cut, scratch, shared_dir  # noqa: F401

#: ASCII white space between words, as a Java / RE2 character class body.
SPACE = r"\x20\x09-\x0D"
#: A run of letters, for Spark's functions.
LETTERS = r"\p{L}+"


def _number_signs() -> str:
    """The signs that Python's ``\\w`` takes for letters though Unicode has them as numbers, as ranges of a class."""
    odd = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(odd), lambda x: x[1] - x[0])]
    return "".join(re.escape(chr(r[0])) + (f"-{re.escape(chr(r[-1]))}" if len(r) > 1 else "") for r in runs)


#: The same run for Python.
LETTER_RUN = re.compile(rf"[^\W\d_{_number_signs()}]+")
_NEARLY = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text. The simpler pattern is twice as fast; what it finds with number signs in it is split again."""
    found = _NEARLY.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ((x,) if x.isalpha() else LETTER_RUN.findall(x))]


def letter_words(text: str) -> set[str]:
    """The different runs of letters of a text."""
    found = set(_NEARLY.findall(text))
    if all(map(str.isalpha, found)):
        return found
    return {w for x in found for w in ((x,) if x.isalpha() else LETTER_RUN.findall(x))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_kept: dict = {}


def kept_by_worker(key: tuple | None, make: Callable | None = None):
    """The worker's own object under a key, made once. A worker keeps one at a time, so that a task of another operator
    frees what the one before needed; with the key None it just frees."""
    if key not in _kept:
        _kept.clear()
        if key is None:
            return None
        _kept[key] = make()
    return _kept[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows: a task that hands whole texts back keeps its buffers, and the JVM's, small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


#: Texts, and bytes of them, whose chunks are told together: what several of them have is looked up once.
TEXTS, BYTES = 2_000, 3_000_000


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of parts of ``TEXTS`` texts and ``BYTES`` bytes at most; a longer text is a part of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(upto):
        most = BYTES + (int(upto[a - 1]) if a else 0)
        b = max(a + 1, min(a + TEXTS, int(np.searchsorted(upto, most, side="right"))))
        yield a, b
        a = b


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` from batches that come sorted by it, one table per run."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if rest and a == 0 and rest[0].column(rest[0].schema.get_field_index(key))[0].as_py() != keys[0]:
                yield pa.Table.from_batches(rest)
                rest = []
            if b < len(keys):
                yield pa.Table.from_batches([*rest, part])
                rest = []
            else:
                rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest)


#: Bits of a :class:`Bloom` at most: its 8 MB are the bound of what is broadcast, whatever the number of items.
MOST_BITS = 1 << 26


class Bloom:
    """A Bloom filter of fixed size: it may say yes to an item that is not there, but never no to one that is.

    Callers use it to leave rows out of a shuffle that could not find a partner there. With more items than it is made
    for, it says yes more often, and more rows are shuffled; results stay the same.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.held = words.astype("<u8").tobytes()  # plain bytes: a test of one bit is several times as fast as through numpy

    @staticmethod
    def places(item: str | bytes, bits: int) -> list[int]:
        h = xxhash.xxh3_128_intdigest(item.encode("utf-8", "surrogatepass") if isinstance(item, str) else item)
        return [(h >> (26 * k)) & (bits - 1) for k in range(4)]

    def __contains__(self, item: str | bytes) -> bool:
        held, most = self.held, 8 * len(self.held) - 1
        if most < 0:
            return False
        h = xxhash.xxh3_128_intdigest(item.encode("utf-8", "surrogatepass") if isinstance(item, str) else item)
        for _ in range(4):  # as ``places``, but most items that are not there go by the first
            p = h & most
            if not held[p >> 3] >> (p & 7) & 1:
                return False
            h >>= 26
        return True


def bloom(items: DataFrame) -> Bloom:
    """The filter of the only column of ``items``, strings or bytes without nulls; reads it twice, so give it a checkpoint."""
    n = items.count()
    bits = 1 << max(16, min(MOST_BITS, 12 * n).bit_length() - 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([p for x in batch.column(0).to_pylist() for p in Bloom.places(x, bits)], dtype=np.int64)
            word, place = np.unique(at >> 6, return_inverse=True)
            held = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(held, place, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(held.view(np.int64))], names=["word", "held"])

    got = items.mapInArrow(task, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()  # MOST_BITS / 64 rows at most
    words = np.zeros(bits >> 6 if n else 0, np.uint64)
    words[got.column("word").to_numpy()] = got.column("held").to_numpy().view(np.uint64)
    return Bloom(words)


#: Edges that one task turns into stars; the number of tasks grows with the edges.
EDGES = 250_000


def _stars(pairs: DataFrame) -> DataFrame:
    """The edges of each partition as ``hi, lo`` with lo the smallest node that the partition's own edges reach."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x, last = up[x], x
                up[last] = up.get(x, x)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(root, nodes)), pa.int64())], names=["hi", "lo"])

    return pairs.mapInArrow(task, "hi long, lo long")


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """Connected components of ``edges (a, b)`` of long ids: ``(node, root)`` with root the smallest node reachable.

    Tasks of about ``per_task`` edges first make stars of their own edges; where that is one task, these are the
    components. Else the large-star and small-star steps alternate with it, each one a grouped shuffle, with a
    checkpoint after each round, so lineage stays short and no node's neighbours are ever gathered in one place.
    Reads ``edges`` twice; give it a checkpoint.
    """
    tasks = max(1, -(-edges.count() // per_task))
    pairs = cut(_stars(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")).coalesce(tasks)))
    mark = None
    while tasks > 1:
        both = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = cut(both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("m", "hi").alias("m")))  # apart, so that the join of a hot node can be split
        large = both.join(low, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = cut(large.where("hi <> lo").distinct())
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        joined = large.join(least, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).unionByName(joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        pairs = cut(_stars(small.where("hi <> lo").distinct().coalesce(tasks)))
        before, mark = mark, tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(20,0)"))).first())  # equal pairs, equal marks
        if mark == before:
            break
    roots = pairs.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).select("node", "root")
