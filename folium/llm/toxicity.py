"""Operator 3: toxicity by multiple-instance learning: sentences are instances, a document's label is their noisy-or."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import LETTERS, cut, held_out, letter_runs

#: Labelled documents that the model is fitted on, at most about so many of each label, drawn by a hash of their ids.
SAMPLE = {1: 3_000, 0: 6_000}
#: The least z-score of a feature's log odds; all that pass are kept, and the bounded sample bounds their number.
LEAST_Z = 3.5
#: A document without any telling sentence is toxic with this probability.
LEAK = 1e-3
THRESHOLD = 0.3
#: Words whose shares a worker remembers before it starts again, and the letters of the longest one it remembers.
MEMO, REMEMBERED = 300_000, 64
_SENTENCE = re.compile(r"[^.!?\n]+")
GRAMS = (4, 5, 7)


def word_features(word: str) -> Iterator[str]:
    """A word itself (marked) and its bounded character n-grams, one at a time as a word may be a whole text."""
    bounded = f"^{word}$"
    yield "=" + word
    for n in GRAMS:
        for i in range(len(bounded) - n + 1):
            yield bounded[i : i + n]


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, text`` of labelled, not held out documents with different texts, about ``SAMPLE`` of each label."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}  # one row per label
    rate = F.lit(0.0)
    for label, most in SAMPLE.items():
        rate = F.when(F.col("toxic") == label, F.lit(min(1.0, most / max(1, counts.get(label, 0))))).otherwise(rate)
    drawn = marks.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < rate)
    # bounded by SAMPLE, so it may go to every task whatever the size of the tables
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy(F.md5(F.coalesce("text", F.lit("")))).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text")


def select_features(labelled: DataFrame) -> dict[str, int]:
    """The features whose document frequencies differ most between the labels, as z-scores of their log odds."""
    split = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(LETTERS), F.lit(0)))
    size = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    words = labelled.select("toxic", F.explode(split).alias("w")).groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"))
    bounded = "concat('^', w, '$')"
    cuts = [f"transform(sequence(1, greatest(length(w) + 3 - {n}, 1)), i -> substr({bounded}, i, {n}))" for n in GRAMS]
    shares = words.select("pos", "neg", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), "w")), *map(F.expr, cuts)))).alias("f"))
    sums = shares.groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 4")
    odds = F.log((F.col("pos") + 0.5) / (size.get(1, 0) + 1.0)) - F.log((F.col("neg") + 0.5) / (size.get(0, 0) + 1.0))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    telling = sums.select("f", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "f")
    return {r["f"]: i for i, r in enumerate(telling.collect())}  # of the bounded sample


def bags(labelled: DataFrame, index: dict[str, int]) -> DataFrame:
    """Per document its label, the sizes of its sentences with any feature, and those features' numbers, as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = [], []
            for text in batch.column(1):
                found = ([index[f] for w in letter_runs(s) for f in word_features(w) if f in index] for s in _SENTENCE.findall((text.as_py() or "").lower()))
                kept = [x for x in found if x]
                sizes.append(np.array([len(x) for x in kept], dtype="<i4").tobytes())
                flat.append(np.array([f for x in kept for f in x], dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(sizes, pa.binary()), pa.array(flat, pa.binary())], names=["toxic", "sizes", "flat"])

    return labelled.mapInArrow(task, "toxic int, sizes binary, flat binary")


def train(label: np.ndarray, bag_sizes: list[np.ndarray], flat: np.ndarray, features: int, rounds: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentence score by gradient ascent on the documents' likelihood under a leaky noisy-or."""
    n = len(label)
    doc = np.repeat(np.arange(n), [len(s) for s in bag_sizes])
    sizes = np.concatenate(bag_sizes) if bag_sizes else np.zeros(0, np.int64)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    w, b = np.zeros(features), -2.0
    if not len(sizes):
        return w, b
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for t in range(1, rounds + 1):
        z = np.clip(b + np.bincount(sentence, w[flat], len(sizes)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clear = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n) + math.log1p(-LEAK)
        whole = np.maximum(-np.expm1(clear), 1e-9)
        pull = np.where(label[doc] == 1, p * np.exp(clear)[doc] / whole[doc], -p)
        g = np.append(np.bincount(flat, pull[sentence], features), pull.sum()) / n
        g[:-1] -= l2 * w / features
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    return w, float(b)


def fitted(bagged: DataFrame, features: int) -> tuple[np.ndarray, float]:
    """:func:`train` in one task over the bounded sample; what comes back is one row of weights."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        label, sizes, flat = [], [], []
        for batch in got:
            label += batch.column(0).to_pylist()
            sizes += [np.frombuffer(x.as_py(), dtype="<i4") for x in batch.column(1)]
            flat += [np.frombuffer(x.as_py(), dtype="<i4") for x in batch.column(2)]
        w, b = train(np.array(label), sizes, np.concatenate(flat) if flat else np.zeros(0, np.int32), features)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([b])], names=["weights", "bias"])

    row = bagged.coalesce(1).mapInArrow(task, "weights array<double>, bias double").first()
    return np.array(row["weights"]), row["bias"]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: a weight for each feature of a telling z-score, and the bias."""
    labelled = sample(docs, labels).persist()
    index = select_features(labelled)
    weights, bias = fitted(cut(bags(labelled, index)), len(index))
    labelled.unpersist()
    return {"weights": {f: float(weights[i]) for f, i in index.items()}, "bias": bias}


class Scorer(dict):
    """Words to their share of a sentence's score, remembered per worker; None for words without any feature."""

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.weights, self.bias = model["weights"], model["bias"]

    def __missing__(self, word: str) -> float | None:
        known = [self.weights[f] for f in word_features(word) if f in self.weights]
        out = sum(known) if known else None
        if len(word) <= REMEMBERED:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of each sentence with any feature."""
        out = []
        for s in _SENTENCE.finditer(text):
            parts = [x for x in map(self.__getitem__, letter_runs(s.group().lower())) if x is not None]
            if parts:
                z = max(-30.0, min(30.0, self.bias + sum(parts)))
                out.append((s.start(), s.end(), 1 / (1 + math.exp(-z))))
        return out


def score_text(scorer: Scorer, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's probability and its offending sentences."""
    found = scorer.sentences(text) if text else []
    clear = 1 - LEAK
    for _, _, p in found:
        clear *= 1 - p
    return 1 - clear, [s for s in found if s[2] >= THRESHOLD]


_scorers: dict = {}


def detect(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and ``offending`` sentences (start, end, score) for every row of ``docs``.

    Null and empty texts get the leak as score and no sentence; repeated rows give equal rows, and different texts may
    tie; an empty table gives none. A text of any length is scored whole, sentence by sentence. Columns other than the id and the text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    holder = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample
    name = uuid.uuid4().hex  # a worker may run several models in turn
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(holder.value)
        for batch in batches:
            got = [score_text(_scorers[name], t.as_py()) for t in batch.column(2)]
            score = pa.array([s for s, _ in got], pa.float64())
            predicted = pa.array([int(s >= THRESHOLD) for s, _ in got], pa.int32())
            spans = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in f] for _, f in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score, predicted, spans], names=["doc_id", "held_out", "score", "predicted", "offending"])

    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")
