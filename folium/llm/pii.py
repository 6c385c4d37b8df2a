"""Operator 10: personal data by patterns, and by what terms reveal: information-theoretic sanitisation.

A term in a text with a protected entity (an e-mail address, IP address, card or phone number) discloses it as far as
the corpus says that who reads the term knows the entity. The entity's information content IC is -log2 of its share of
the texts; a term takes PMI(term, entity) bits of it away, and IC - PMI bits are left. Terms that leave ``GENERALISE``
bits or less, and take at least ``GAIN`` of IC, are generalised, those that leave ``REMOVE`` or less removed, wherever
they occur in any text. Bits left do not depend on the size of the corpus, so the rule is the same at every size.

One text with both is evidence enough: who searches the corpus for a word of one text alone finds that text, and with it
whom it is about, whether or not the word says anything of itself. What a term becomes is held to the same measure, as
it will stand in the sanitised texts: a beginning shared with other terms is taken only if, in all the texts that it
comes to stand in, it does not disclose an entity in turn.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count, repeat

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folium.llm.common import LETTER_RUN, Bloom, bloom, cut, kept_by_worker, letter_words, slices

KINDS = ("email", "ip", "card", "phone", "term")
#: What is added to the counts of a pair's ends: rare pairs, which may be chance, leave more bits, and none is left out.
SMOOTH = 0.25
#: Most bits that a term may leave, and the least share of an entity's information that it must take. 0.7 bits are left
#: where the entity is in three of five texts with the term, and by a term that was seen just once, 0.64.
GENERALISE, REMOVE, GAIN = 0.7, 0.3, 0.8
#: Different terms that a task counts before it hands them on, and words it remembers.
COUNTED, MEMO = 200_000, 300_000
#: Lengths of beginnings that may stand for terms: each half as long again as the one before, for words of any length.
STARTS = [2, 3]
while STARTS[-1] < 1 << 30:
    STARTS.append(STARTS[-1] * 3 // 2)
#: What stands for a term that shares no beginning that would do.
ANY = "[TERM]"

_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds an @ with the longest run of local characters before it, so only those places are tried."""
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        local = len(head) - len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = "".join(_DIGITS.findall(m.group()))
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m.group())) <= 15]
    return out


def _entity(kind: int, value: str) -> str:
    """What makes two mentions the same entity."""
    return f"{kind}:" + (value.lower() if kind == 0 else value if kind == 1 else "".join(_DIGITS.findall(value)))


def _number(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def words_of(text: str) -> list[str]:
    """The different words of a text, lower-cased, of any length and wherever they stand."""
    return list({w.lower() for w in letter_words(text)})


class _Wanted(dict):
    """Words as they stand to their lower case where a filter has it, else None; short ones are remembered."""

    def __init__(self, wanted: Bloom) -> None:
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> str | None:
        low = word.lower()
        out = low if low in self.wanted else None
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out

    def words_of(self, text: str) -> list[str]:
        """The words of :func:`words_of` that the filter has."""
        found = set(map(self.__getitem__, letter_words(text)))
        found.discard(None)
        return list(found)


def scan(docs: DataFrame) -> DataFrame:
    """``text_key, entities, terms`` of the texts with entities, once per different text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker(None)
        for batch in batches:
            cols: list[list] = [[], [], []]
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                base = base_spans(text)
                if base:
                    cols[0].append(key)
                    cols[1].append(list({_number(_entity(k, text[a:b])) for k, a, b in base}))
                    cols[2].append(words_of(text))
            kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["text_key", "entities", "terms"])

    found = docs.select(text_key(F.col("text")).alias("text_key"), "text").mapInArrow(task, "text_key binary, entities array<long>, terms array<string>")
    return found.dropDuplicates(["text_key"])


def _terms(words: DataFrame, holder, repeated) -> DataFrame:
    """``text_key, terms, counts`` from ``text_key, text``: the words in the ``holder`` filter.

    Texts in the ``repeated`` filter give a row of their own, so that their copies can be dropped; with it None, all
    do. Words of other texts are counted within the task and handed on in parts under a key of their own, made of the
    partition's number and a running one: a task that runs again gives the same parts under the same keys.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker(None)
        wanted, twice = _Wanted(holder.value), repeated.value if repeated else None
        counts: Counter[str] = Counter()
        seen: set[bytes] = set()  # texts of this task that gave a row
        own_key = map("{}-{}".format, repeat(TaskContext.get().partitionId()), count())  # never as long as a text's key

        def part(keys: list, terms: list, n: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(terms, pa.list_(pa.string())), pa.array(n, pa.list_(pa.int64()))], names=["text_key", "terms", "counts"])

        def flush() -> Iterator[pa.RecordBatch]:
            words = sorted(counts)
            for a in range(0, len(words), 2048):
                own = words[a : a + 2048]
                yield part([next(own_key).rjust(20).encode()], [own], [[counts[w] for w in own]])
            counts.clear()

        for batch in batches:
            keys, terms = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = twice is None or key in twice
                if own and key in seen:
                    continue
                found = wanted.words_of(text.as_py() or "")
                if own and found:
                    seen.add(key)
                    keys.append(key)
                    terms.append(found)
                elif not own:
                    counts.update(found)
                    if len(counts) >= COUNTED:
                        yield from flush()
            yield part(keys, terms, [[1] * len(t) for t in terms])
        yield from flush()

    return words.mapInArrow(task, "text_key binary, terms array<string>, counts array<long>").dropDuplicates(["text_key"])


def word_counts(docs: DataFrame, terms: DataFrame, copies: DataFrame) -> DataFrame:
    """``term, df_term``: the number of different texts with each word of ``terms (term)``, and of some other words.

    Filters of fixed size keep the words of clean texts, and all texts but repeated ones, out of the shuffles.
    """
    sc = docs.sparkSession.sparkContext
    holder, repeated = sc.broadcast(bloom(terms)), sc.broadcast(bloom(cut(copies.where("n > 1").select("text_key"))))
    counted = _terms(docs.select(text_key(F.col("text")).alias("text_key"), "text"), holder, repeated)
    return counted.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df_term"))


def left(joint: Column, df_term: Column, df_entity: Column) -> Column:
    """The bits of information that an entity still holds for who reads the term: its information content less the
    smoothed PMI of the two, which is -log2 of the share of the term's texts that have the entity."""
    return F.log2((df_term + SMOOTH) * (df_entity + SMOOTH) / (joint * df_entity))


def disclosing(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``term, action, general``: the words of whole texts that disclose an entity of theirs, with the stronger action.

    Every pair of an entity and a word of one text is scored, however rare. All counts are of different texts, so that
    copying a text does not make its words disclosing. As a pair occurs no oftener than its entity, a word can only
    leave ``generalise`` bits with df_term + SMOOTH <= 2^generalise * df_entity: words that are more common are left out
    before pairs are made, which loses none. Entities of one text alone score alike, so one of them stands for all.

    ``general`` is what a term becomes: the longest beginning, of a length in ``STARTS``, that does not disclose where it
    will stand; ``[TERM]`` where there is none; the empty string for a removed term, and where ``[TERM]`` itself discloses.
    """
    scanned = cut(scan(docs))
    copies = cut(docs.groupBy(text_key(F.col("text")).alias("text_key")).agg(F.count("*").alias("n")))
    total = max(copies.count(), 1)
    entities = cut(scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df_entity")))
    most = entities.agg(F.max("df_entity")).first()[0] or 0
    factor = 2**generalise * (1 + 1e-9)
    words = scanned.select("text_key", F.explode("terms").alias("term"))
    counts = cut(word_counts(docs, words.select("term"), copies))  # apart, so that the join of a hot word can be split
    words = words.join(counts.where(F.col("df_term") + SMOOTH <= factor * most), "term")
    ends = cut(scanned.select("text_key", F.explode("entities").alias("entity")).join(entities, "entity"))
    alone = ends.where("df_entity = 1").groupBy("text_key").agg(F.min("entity").alias("entity"), F.first("df_entity").alias("df_entity"))
    ends = alone.unionByName(ends.where("df_entity > 1"))
    pairs = words.join(ends, "text_key").where(F.col("df_term") + SMOOTH <= factor * F.col("df_entity"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("joint"), F.first("df_term").alias("df_term"), F.first("df_entity").alias("df_entity"))
    bits = pairs.select("term", "df_entity", left(F.col("joint"), F.col("df_term"), F.col("df_entity")).alias("bits"))
    bits = bits.where((F.col("bits") <= generalise) & (F.col("bits") <= (1 - GAIN) * F.log2(F.lit(float(total)) / F.col("df_entity"))))
    best = cut(bits.groupBy("term").agg(F.min("bits").alias("bits"), F.max("df_entity").alias("df_entity")))
    kept = best.where(F.col("bits") > remove).select("term")
    held = cut(scanned.select("text_key", F.explode("terms").alias("term")).join(kept, "term").select("text_key", "term"))
    lengths = F.filter(F.array(*map(F.lit, STARTS)), lambda n: n < F.length("term"))
    starts = held.select("text_key", "term", F.explode(F.transform(lengths, lambda n: F.substring("term", F.lit(1), n))).alias("form"))
    safe = starts.select("text_key", "form").distinct().transform(_hidden, ends, total, generalise)
    first = starts.select("term", "form").distinct().join(safe, "form").groupBy("term").agg(F.max_by("form", F.length("form")).alias("form"))
    # terms that went to longer beginnings are missing from shorter ones, so that what is taken is measured once more
    taken = held.join(first, "term")
    first = first.join(taken.select("text_key", "form").distinct().transform(_hidden, ends, total, generalise), "form")
    general = cut(kept.join(first, "term", "left").select("term", F.concat("form", F.lit("…")).alias("form")))
    others = held.join(general.where("form IS NULL").select("term"), "term", "left_semi").select("text_key", F.lit(ANY).alias("form")).distinct()
    any_form = F.lit("" if others.transform(_hidden, ends, total, generalise).isEmpty() else ANY)
    out = best.select("term", "bits").join(general, "term", "left")
    out = out.select("term", F.when(F.col("bits") <= remove, "").otherwise(F.coalesce("form", any_form)).alias("general"))
    return cut(out.select("term", F.when(F.col("general") == "", "remove").otherwise("generalise").alias("action"), "general"))


def _hidden(places: DataFrame, ends: DataFrame, total: int, generalise: float) -> DataFrame:
    """The forms of ``places (text_key, form)``, the texts in which they will stand, that do not disclose an entity of theirs.

    Texts without entities are not among the places; with them a form would disclose less. With e texts of an entity and
    j of them with the form, a form in n texts leaves no more than some bits where log2(n + SMOOTH) is at most those bits
    and log2(j e / (e + SMOOTH)); the entity for which that is most decides.
    """
    joint = places.join(ends, "text_key").groupBy("form", "entity").agg(F.count("*").alias("joint"), F.first("df_entity").alias("e"))
    bits = F.least(F.lit(generalise), (1 - GAIN) * F.log2(F.lit(float(total)) / F.col("e")))
    reach = joint.groupBy("form").agg(F.max(bits + F.log2(F.col("joint") * F.col("e") / (F.col("e") + SMOOTH))).alias("reach"))
    texts = places.groupBy("form").agg(F.count("*").alias("n"))
    return texts.join(reach, "form").where(F.log2(F.col("n") + SMOOTH) > F.col("reach") + 1e-9).select("form")


def _with_terms(docs: DataFrame, at: int, hits: DataFrame, apply: Callable[[pa.RecordBatch, list[dict[str, str]]], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """``apply(batch, terms)`` to all rows of ``docs``, whose text is column ``at``, with each row's disclosing terms.

    The terms of each different text are found by a join with ``hits`` of the words that pass a filter of fixed size.
    A second filter tells the texts without any, which are done where they lie; the others' are joined by their key.
    """
    sc, n = docs.sparkSession.sparkContext, len(docs.columns)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).withColumn("text_key", text_key(F.col(f"c{at}")))
    candidates = _terms(rows.select("text_key", f"c{at}"), sc.broadcast(bloom(hits.select("term"))), None)
    pairs = candidates.select("text_key", F.explode("terms").alias("term")).join(hits, "term")
    found = cut(pairs.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "general"))).alias("terms")))  # the words of one text
    holder = sc.broadcast(bloom(found.select("text_key")))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [i for i, key in enumerate(batch.column(n).to_pylist()) if key not in holder.value]
            part = batch.take(pa.array(keep, pa.int64()))
            yield apply(part.select(list(range(n))), [{}] * len(keep))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.take(pa.array([i for i, key in enumerate(batch.column(n).to_pylist()) if key in holder.value], pa.int64()))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield apply(batch.select(list(range(n))), [dict(x.as_py() or ()) for x in batch.column(n)])

    touched = rows.mapInArrow(others, rows.schema).join(found, "text_key", "left").select(*rows.columns[:n], "terms")
    return rows.mapInArrow(plain, schema).unionByName(touched.mapInArrow(joined, schema))


def occurrences(text: str, base: list[tuple[int, int, int]], terms: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, what it becomes) of every word of ``text`` that is one of ``terms``, outside of all base spans."""
    found = [(m.start(), m.end(), a) for m in LETTER_RUN.finditer(text) if (a := terms.get(m.group().lower())) is not None] if terms else []
    if not found or not base:
        return found
    cover: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    starts = [a for a, _ in cover]
    free = lambda s, e: (i := bisect_left(starts, e) - 1) < 0 or cover[i][1] <= s
    return [x for x in found if free(x[0], x[1])]


_DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts and digest of the base spans, and all spans with the disclosing terms.

    Null text counts as empty and has no spans; a text of any length is read whole; every row gives one row, repeated
    rows equal ones; an empty table gives none. Columns other than the id and the text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def apply(batch: pa.RecordBatch, terms: list[dict[str, str]]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for value, own in zip(batch.column(1), terms, strict=True):
            text = value.as_py() or ""
            base = base_spans(text)
            for k in range(4):
                cols[k].append(sum(s[0] == k for s in base))
            joined = _joined(base)
            cols[4].append(hashlib.sha256(joined.encode()).hexdigest())
            cols[5].append(",".join(filter(None, [joined, *(f"term:{a}:{b}" for a, b, _ in occurrences(text, base, own))])))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return _with_terms(docs, 1, disclosing(docs), apply, _DIGEST)


def redact(text: str, terms: dict[str, str]) -> str:
    """Entities become their kind in brackets, disclosing terms what ``terms`` has for them."""
    base = base_spans(text)
    spans = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b in base]
    extra = occurrences(text, base, terms)
    spans += extra
    out, at = [], 0
    for a, b, word in sorted(spans):
        if a >= at:
            out += [text[at:a], word]
            at = b
        elif b > at:  # overlaps the span before: what is left of it goes too
            at = b
    clean = "".join([*out, text[at:]])
    return redact(clean, {}) if extra and base_spans(clean) else clean  # what a removed term stood between


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the text redacted, all columns and rows kept; null and empty texts stay as they are.

    A text of any length is read whole, repeated rows stay equal, and an empty table gives none. Columns may have any
    other names and pass through.
    """
    names = docs.columns
    at = names.index("text")

    def apply(batch: pa.RecordBatch, terms: list[dict[str, str]]) -> pa.RecordBatch:
        texts = [t.as_py() and redact(t.as_py(), own) for t, own in zip(batch.column(at), terms, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return _with_terms(docs, at, disclosing(docs.select("doc_id", "text")), apply, docs.schema)
