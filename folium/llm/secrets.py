"""Operator 5: secret scans by built-in functions only: fixed patterns plus sliding-window entropy of candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import let

_WORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""(?:{_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Candidate strings for the entropy scan: long tokens that mix letters and digits.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
WINDOW = 20
#: Fixed values, (class, pattern that a candidate must match wholly, alphabet, least entropy in bits over WINDOW characters);
#: the first class that matches a candidate is its class.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", "0123456789abcdef", 3.0),
    ("alnum", r"^[A-Za-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.6),
    ("base64", r"^[A-Za-z0-9+/_-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-", 3.8),
)
#: Candidates that match one of these are never reported by the entropy scan.
ALLOW = (
    r"^[0-9]+$",
    r"^[A-Za-z+/_-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?:[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Tt][Ee][Ss][Tt][Kk][Ee][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr])",
    r"(?:[a-z]+[-_/]){3,}",
)
KINDS = ("assign", "access", "hex", "entropy")


def running(values: Column, join) -> Column:
    """Each value of an array joined with all before it: steps of 1, 2, 4, ... places, as many as the array's length asks for."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: F.coalesce(join(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))), x))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(steps, values, step))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """``array<struct(start, kind, end, value)>`` of all leftmost matches, in code points.

    The pieces between the matches and the matches themselves are cut by the same pattern, so that their lengths,
    summed in turn, give the places.
    """
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")

    def placed(gaps: Column, found: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        ends = let(lengths, lambda x: running(x, lambda a, b: a + b))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda g: placed(g, m))))


def max_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` adjacent characters of ``value``.

    Counts per character move with the window: a step adds the entering character and takes off the leaving one,
    and the sum of c * log2(c) changes by these two counts alone.
    """
    logs = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])

    def fold(at: Column) -> Column:
        zero = F.struct(F.expr(f"array_repeat(0, {len(alphabet) + 1})").alias("n"), F.lit(0.0).alias("s"), F.lit(float(window * 64)).alias("least"))

        def step(acc: Column, x: Column) -> Column:
            leaving = F.when(x["i"] >= window, F.get(at, x["i"] - window)["a"]).otherwise(F.lit(-1))
            more, less = F.get(acc["n"], x["a"]), F.get(acc["n"], leaving)
            same = leaving == x["a"]
            s = F.when(same, acc["s"]).otherwise(
                acc["s"] + F.get(logs, more + 1) - F.get(logs, more) + F.when(leaving >= 0, F.get(logs, less - 1) - F.get(logs, less)).otherwise(0.0)
            )
            n = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda v, k: v + (k == x["a"]).cast("int") - (k == leaving).cast("int")))
            least = F.when(x["i"] >= window - 1, F.least(acc["least"], s)).otherwise(acc["least"])
            return F.struct(n.alias("n"), s.alias("s"), least.alias("least"))

        return F.aggregate(at, zero, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)

    chars = F.transform(F.split(value, ""), lambda c, i: F.struct(F.instr(F.lit(alphabet), c).alias("a"), i.alias("i")))
    return let(chars, fold)


def _suspicious(value: Column, window: int) -> Column:
    """Whether a candidate is no allowed string and some window of it reaches its class's entropy."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | value.rlike(pattern)
    verdict = F.lit(False)
    for _, pattern, alphabet, least in reversed(CLASSES):
        folded = F.lower(value) if alphabet == CLASSES[0][2] else value
        verdict = F.when(value.rlike(pattern), F.round(max_entropy(folded, alphabet, window), 6) >= least).otherwise(verdict)
    return F.when(allowed, F.lit(False)).otherwise(verdict)


def _outside(spans: Column) -> Column:
    """Spans in order without those of the entropy scan that lie within a base span: one that begins no later, thus stands before, and reaches as far."""
    reach = F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0))
    return let(let(reach, lambda r: running(r, F.greatest)), lambda r: F.filter(spans, lambda x, i: (x["kind"] < 3) | (F.get(r, i) < x["end"])))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, found``: all spans of a text as ``array<struct(start, kind, end, value)>`` in order of start, then kind.

    Null text counts as empty and has no spans. Every row of ``docs`` gives one row, repeated rows too; other
    columns are ignored. An empty table gives no rows. A text of any length is read whole, and n spans in it take steps of
    the order of n log n. Entropy spans that lie
    within a base span are left out; an entropy that ties with its class's least, to six digits, counts.
    """
    text = F.col("_t")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    value = lambda x: F.regexp_extract(x["value"], ASSIGN, 1)
    d = d.withColumn("_b", F.array_sort(F.concat(F.filter(_spans(text, ASSIGN, 0), lambda x: F.length(value(x)) >= 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2))))
    d = d.withColumn("_c", F.filter(_spans(text, CANDIDATE, 3), lambda x: _suspicious(x["value"], window)))
    return d.select("doc_id", F.col("_b").alias("base"), F.when(F.size("_c") == 0, F.col("_b")).otherwise(let(F.array_sort(F.concat("_b", "_c")), _outside)).alias("found"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan`."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    d = scan(docs)
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    base = rf"""SELECT rid, 0 kind, m, g FROM (SELECT rid, regexp_extract_all(t, {quoted(ASSIGN)}) m, regexp_split_to_array(t, {quoted(ASSIGN)}) g FROM d)"""
    runs = []
    for kind, chars, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24), (3, "[A-Za-z0-9+/_-]+", 20)):
        runs.append(f"SELECT rid, {kind} kind, regexp_extract_all(t, '{chars}') m, regexp_split_to_array(t, '{chars}') g FROM d")
    klass = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN {least}" for _, p, _, least in CLASSES) + " END"
    allowed = " OR ".join(f"regexp_matches(v, '{p}')" for p in ALLOW)
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
cut AS ({base} UNION ALL {" UNION ALL ".join(runs)}),
one AS (SELECT rid, kind, unnest(m) v, unnest(list_transform(range(1, len(m) + 1), lambda i:
          list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)))::BIGINT s FROM cut WHERE len(m) > 0),
base AS (SELECT rid, kind, s, s + length(v) e FROM one WHERE CASE kind WHEN 0 THEN length(regexp_extract(v, {quoted(ASSIGN)}, 1)) >= 6
          WHEN 1 THEN length(v) >= 20 WHEN 2 THEN length(v) >= 24 ELSE false END),
cand AS (SELECT rid, v, s, s + length(v) e, {klass} least, regexp_matches(v, '{CLASSES[0][1]}') hex FROM one WHERE kind = 3 AND length(v) >= 20 AND NOT ({allowed})),
win AS (SELECT rid, s, e, least, i, substr(CASE WHEN hex THEN lower(v) ELSE v END, i, {WINDOW}) w FROM (SELECT *, unnest(range(1, length(v) - {WINDOW} + 2)) i FROM cand)),
chars AS (SELECT rid, s, e, least, i, c, count(*) n FROM (SELECT *, unnest(string_split(w, '')) c FROM win) GROUP BY ALL),
ent AS (SELECT rid, s, e, least, i, -sum(n / {WINDOW}.0 * log2(n / {WINDOW}.0)) h FROM chars GROUP BY ALL),
extra AS (SELECT rid, 3 kind, s, e FROM ent GROUP BY rid, s, e, least HAVING round(max(h), 6) >= least),
found AS (SELECT *, true b FROM base UNION ALL
  SELECT *, false b FROM extra x WHERE NOT EXISTS (SELECT 1 FROM base y WHERE y.rid = x.rid AND y.s <= x.s AND y.e >= x.e)),
agg AS (SELECT rid, count(*) FILTER (WHERE kind = 0) a, count(*) FILTER (WHERE kind = 1) k, count(*) FILTER (WHERE kind = 2) h,
  coalesce(string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE b), '') bs,
  string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind) sp FROM found GROUP BY rid)
SELECT doc_id, coalesce(a, 0) n_assign, coalesce(k, 0) n_access, coalesce(h, 0) n_hex, sha256(coalesce(bs, '')) base_sha256, coalesce(sp, '') spans
FROM d LEFT JOIN agg USING (rid)
"""


ORACLE = _sql()
