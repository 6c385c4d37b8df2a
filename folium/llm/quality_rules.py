"""Operator 1: quality rules as one threshold table compiled into one Spark projection (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import SPACE, let

#: Common words of the supported languages.
STOP_WORDS = (
    "the of and to in is was that for with as on be at by this are from it or an "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des du et en un une est que pour dans par sur au avec "
    "el los las y del se por con una para su al lo como"
).split()

#: (rule, numerator, comparison, percent, denominator): a text fails a rule when 100 * numerator <op> percent * denominator.
THRESHOLDS = (
    ("words_too_short", "word_chars", "<", 200, "n_words"),
    ("words_too_long", "word_chars", ">", 1800, "n_words"),
    ("symbols", "n_symbols", ">", 10, "n_words"),
    ("shouting", "n_upper", ">", 4000, "word_chars_100"),
    ("few_stop_words", "n_stop_words", "<", 2, "n_words"),
    ("dup_lines", "n_dup_lines", ">", 60, "n_lines"),
    ("ellipsis_lines", "n_ellipsis_lines", ">", 30, "n_lines"),
    ("bullet_lines", "n_bullet_lines", ">", 90, "n_lines"),
)
WINDOW = 8


def _stop_forms() -> list[str]:
    """Each stop word in lower case or capitalised, bare or before one mark."""
    words = sorted(set(STOP_WORDS))
    return [w + mark for w in words + [w.capitalize() for w in words] for mark in ("", *".,;:!?")]


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash for each window of WINDOW = 8 words, by three doublings of the words' own hashes."""

    def doubled(step: int):
        return lambda h: F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    out = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        out = let(out, doubled(step))
    return out


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the hashes of all windows of a text.

    Windows are sorted with their places, equal neighbours are marked, and the marked places' spans are united.
    """

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def marked(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["w"] == b["w"], F.array(a["p"], b["p"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

    placed = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("p")))
    return let(let(F.sort_array(placed), marked), covered)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS, keep: list[str] | None = None) -> DataFrame:
    """Measures and verdict per row of ``docs``.

    Null text counts as empty: no words, hence base_failed and not kept. Every row gives one row, repeated rows
    included; other columns of ``docs`` are ignored, so clashing names do no harm. An empty table gives no rows. A text
    of any length is measured whole. A measure that ties with its threshold passes.
    ``keep`` names columns of ``docs`` to carry along. ``failed`` names the first rule of ``thresholds`` that the text fails, null if none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.struct(*(keep or [id_col])).alias("_held")
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), held)
    d = d.withColumn("_w", F.array_remove(F.split("_t", f"[{SPACE}]+", -1), ""))
    d = d.withColumn("_h", _window_hashes(F.col("_w")))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    forms = _stop_forms()
    size = lambda c: F.size(c).cast("long")
    d = d.select(
        "doc_id",
        "_held",
        size("_w").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (size("_l") - size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), 0).otherwise(_repeat_words(F.col("_h"))).cast("long").alias("n_repeat_words"),
        size("_l").alias("n_lines"),
        size(F.filter("_l", lambda x: x.rlike(rf"(?:\.\.\.|…)[{SPACE}]*$"))).alias("n_ellipsis_lines"),
        size(F.filter("_l", lambda x: x.rlike(rf"^[{SPACE}]*[-*•‣]"))).alias("n_bullet_lines"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        size(F.filter("_w", lambda x: x.isin(forms))).alias("n_stop_words"),
    )
    measures = {c: F.col(c) for c in d.columns if c != "_held"} | {"word_chars_100": F.col("word_chars")}
    verdicts = []
    for name, top, op, percent, bottom in thresholds:
        scale = 10_000 if bottom == "word_chars_100" else 100
        left, right = measures[top] * scale, measures[bottom] * percent
        verdicts.append(F.when(left < right if op == "<" else left > right, F.lit(name)))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = d.withColumn("base_failed", base).withColumn("failed", F.coalesce(F.when(base, F.lit("base")), *verdicts))
    d = d.withColumn("kept", F.col("failed").isNull())
    return d.select("*", *[F.col("_held")[c].alias(c) for c in keep or [] if c != "doc_id"]).drop("_held")


def _sql_rules(thresholds=THRESHOLDS) -> str:
    parts = ["WHEN base_failed THEN 'base'"]
    for name, top, op, percent, bottom in thresholds:
        scale = 10_000 if bottom == "word_chars_100" else 100
        parts.append(f"WHEN {top} * {scale} {op} {bottom.removesuffix('_100')} * {percent} THEN '{name}'")
    return "CASE " + " ".join(parts) + " END"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + 7) v FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) n FROM rep, range(8) r(k) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(cov.n, 0)::BIGINT n_repeat_words, len(ls)::BIGINT n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT n_ellipsis_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]')))::BIGINT n_bullet_lines,
    length(regexp_replace(array_to_string(ws, ' '), '\P{{Lu}}+', '', 'g'))::BIGINT n_upper,
    len(list_filter(ws, lambda x: x IN ({", ".join(f"'{x}'" for x in _stop_forms())})))::BIGINT n_stop_words
  FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
r AS (SELECT *, {_sql_rules()} AS failed FROM b)
SELECT *, failed IS NULL AS kept FROM r
"""
