"""Operator 2: language identification by known words first, then by shorter and shorter character n-grams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import LETTERS, held_out, kept_by_worker, letter_runs, slices

UNKNOWN = "und"
#: Labelled documents per language that the model is fitted on: about so many are drawn by a hash of their ids.
SAMPLE = 4_000
#: How often the sample must have a word in a language for it to be known there, the longest n-gram, and the least weight
#: (in words) added to every count. Rarer words, whose share is chance, are told by their n-grams, of which all are kept.
LEAST, LONGEST, SMOOTH = 3, 5, 0.5
#: Words whose scores a worker remembers before it starts again, and the letters of the longest one it remembers.
MEMO, REMEMBERED = 150_000, 64


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """Labelled, not held out documents, about ``per_language`` of each language, drawn by a hash of the id.

    The share to draw comes from the languages' row counts, so every source and id range is drawn alike.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    rate = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(rate)
    place = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(place < rate).select("lang", "text")


def fit(labelled: DataFrame, least: int = LEAST, longest: int = LONGEST) -> dict:
    """The model from ``lang, text``: languages, known words and n-grams by length, each with a log share per language.

    Words are counted by Spark; n-grams are counted over distinct words weighted by their counts. No word of evidence and
    no n-gram is left out: what reaches the driver, as one Arrow table, is bounded by the bounded sample alone.
    """
    split = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(LETTERS), F.lit(0))
    counts = labelled.select("lang", F.explode(split).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    known = F.when(F.col("n") >= least, F.array(F.struct(F.lit(0).alias("size"), F.col("w").alias("g")))).otherwise(F.array())
    cuts = [F.expr(f"transform(sequence(1, greatest(length(w) + 3 - {k}, 1)), i -> struct({k} as size, substr(concat('^', w, '$'), i, {k}) as g))") for k in range(1, longest + 1)]
    parts = counts.select("lang", "n", F.explode(F.concat(known, *cuts)).alias("p")).where((F.col("p.size") == 0) | (F.length("p.g") == F.col("p.size")))
    sums = parts.groupBy("lang", F.col("p.size").alias("size"), F.col("p.g").alias("g")).agg(F.sum("n").alias("n"))
    told = sums.select("lang", "size", "g", "n").toArrow()
    langs = sorted(set(told.column("lang").to_pylist()))
    size, n = told.column("size").to_numpy(), told.column("n").to_numpy()
    lang = np.searchsorted(np.array(langs), np.array(told.column("lang").to_pylist())) if langs else np.zeros(0, int)
    model = {"langs": langs, "tables": {}}
    for k in range(longest + 1):
        own = np.nonzero(size == k)[0]
        names = told.column("g").take(pa.array(own)).combine_chunks().dictionary_encode()
        total = np.zeros((len(names.dictionary), len(langs)))
        np.add.at(total, (names.indices.to_numpy(), lang[own]), n[own])
        shares = np.log((total + SMOOTH) / (total.sum(axis=0) + SMOOTH * len(total)))
        model["tables"][k] = Table(names.dictionary.to_pylist(), shares)
    return model


class Table:
    """Words to rows of one matrix: an array of its own for each word would take most of a worker's memory."""

    def __init__(self, words: list[str], shares: np.ndarray) -> None:
        self.place = {w: i for i, w in enumerate(words)}
        self.shares = shares

    def __contains__(self, word: str) -> bool:
        return word in self.place

    def __getitem__(self, word: str) -> np.ndarray:
        return self.shares[self.place[word]]

    def get(self, word: str) -> np.ndarray | None:
        return self[word] if word in self.place else None


class Scorer(dict):
    """Words to rows of a matrix of log scores per language, relative to the best one; remembered per worker."""

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.tables = model["tables"]
        self.sizes = sorted((s for s in self.tables if s), reverse=True)
        self.rows = np.zeros((MEMO, len(model["langs"])))

    def score(self, word: str) -> np.ndarray | None:
        out = self.tables[0].get(word)
        if out is None:
            bounded = f"^{word}$"
            for size in self.sizes:  # the longest size of which any n-gram is known decides
                table = self.tables[size]
                total, n = 0.0, 0
                for i in range(len(bounded) - size + 1):
                    g = bounded[i : i + size]
                    if g in table and (size > 1 or g not in "^$"):
                        total, n = total + table[g], n + 1
                if n:
                    return total / n
        return out

    def relative(self, word: str) -> np.ndarray | float:
        out = self.score(word)
        return 0.0 if out is None else out - out.max()

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.rows[row] = self.relative(word)
        return row

    def total(self, words: list[str]) -> np.ndarray:
        out = np.zeros(self.rows.shape[1])
        for a in range(0, len(words), 4096):
            part = [w for w in words[a : a + 4096] if len(w) <= REMEMBERED]
            for word in words[a : a + 4096] if len(part) < min(4096, len(words) - a) else ():
                if len(word) > REMEMBERED:
                    out += self.relative(word)
            if len(self) + len(part) > MEMO:
                self.clear()
            out += self.rows[np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))].sum(axis=0)
        return out


def predict_text(scorer: Scorer, langs: list[str], text: str | None) -> tuple[str, float]:
    """The language and its share of the languages' mean likelihoods; ``und`` and 0 where there is no letter."""
    words = letter_runs(text.lower()) if text else []
    if not words or not langs:
        return UNKNOWN, 0.0
    total = scorer.total(words)
    shares = np.exp((total - total.max()) / len(words))
    best = int(np.argmax(shares))
    return langs[best], float(shares[best] / shares.sum())


def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Null texts and texts without a letter (signs such as ``½ ² Ⅳ`` are none) give ``und`` with score 0; equal scores
    give the first language by name; repeated rows give equal rows; an empty table gives none. A text of any length is
    scored whole, and so is a word: one of over ``REMEMBERED`` letters is scored each time anew. Columns other than the id and the text are not read,
    but those named in ``keep`` are carried along.
    """
    more = [c for c in keep or [] if c != "doc_id"]
    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("_text"), *more)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    holder = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE texts per language
    name = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(name, holder)
        langs = holder.value["langs"]
        for batch in slices(batches):
            pairs = [predict_text(scorer, langs, t.as_py()) for t in batch.column(2)]
            pred, score = zip(*pairs, strict=True) if pairs else ((), ())
            told = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *told, *batch.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", *more])

    return rows.mapInArrow(task, schema)


def worker_scorer(name: str, holder) -> Scorer:
    """The worker's scorer of a call, by the call's own name: an address may be taken again by a later model."""
    return kept_by_worker(("scorer", name), lambda: Scorer(holder.value))
