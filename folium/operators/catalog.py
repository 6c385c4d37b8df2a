"""Catalog search: prefix text, filters, facets, summaries and pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import ascii_lower, fts_phrases, fts_text, split_csv, title_key_texts
from folium.operators.ordered import keep_least

UNKNOWN = "unknown"
#: Rows of a page at most.
MOST_ROWS = 200
#: How a match was made, of those that count as accepted.
ACCEPTED = ("link", "cross-id", "title+author", "title-unique", "manual")


def text_match(query: str, *columns: str) -> Column | None:
    """Every word of ``query`` as a phrase prefix in one of the columns; None where no word has a letter or digit. The
    columns are folded once for all words."""
    phrases, texts = fts_phrases(query), [fts_text(F.col(c)) for c in columns]
    every = lambda ts: reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for t in ts]) for p in phrases])
    if len(phrases) < 2:
        return every(texts) if phrases else None
    return F.transform(F.array(F.array(*texts)), lambda ts: every([ts[i] for i in range(len(columns))]))[0]


def contains_ci(column: str, part: str, *more: str) -> Column:
    """Whether the part is in any of the columns, ASCII case ignored."""
    return reduce(lambda a, b: a | b, [F.contains(ascii_lower(F.coalesce(c, F.lit(""))), ascii_lower(F.lit(part))) for c in (column, *more)])


def known(column: str) -> Column:
    """A match's value where a series is accepted, else ``unknown``."""
    return F.coalesce(F.when(F.col("series_id").isNotNull(), F.col(column)), F.lit(UNKNOWN))


def where(rows: DataFrame, query: str = "", modules: list[str] | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), status: str | None = None, format: str | None = None) -> DataFrame:
    """The conjunction of the filters that are given."""
    parts = [text_match(query, "title", "alttitles")]
    parts += [F.col("module_id").isin(modules)] if modules is not None else []
    parts += [contains_ci("genres", g) for g in include] + [~contains_ci("genres", g) for g in exclude]
    parts += [F.col("status") == status] if status is not None else []
    parts += [known("format") == format] if format is not None else []
    return reduce(lambda d, p: d.where(p), [p for p in parts if p is not None], rows)


def accepted(matches: DataFrame) -> DataFrame:
    """Matches as they count: without a series where how they were made is not accepted."""
    return matches.withColumn("series_id", F.when(F.col("confidence").isin(*ACCEPTED), F.col("series_id")))


def matched(listing: DataFrame, matches: DataFrame) -> DataFrame:
    """Catalog rows with their own module's match."""
    return listing.join(accepted(matches), ["module_id", "link"], "left")


def numbered_page(rows: DataFrame, number: int, size: int, *columns: str) -> DataFrame:
    """Page ``number``, from 1, of ``size`` rows, 1 to MOST_ROWS, each with the ``total`` of all pages' rows. Nothing runs
    until the page is asked for."""
    size = min(max(size, 1), MOST_ROWS)
    return page(rows, (max(number, 1) - 1) * size, size, *columns).withColumn("total", rows.agg(F.count("*").alias("total")).scalar())


def page(rows: DataFrame, offset: int, limit: int, *columns: str) -> DataFrame:
    """A page in stable order: title without ASCII case, module, link."""
    return rows.orderBy(ascii_lower(F.col("title")), "module_id", "link").offset(max(0, offset)).limit(max(1, limit)).select(*columns)


def page_after(rows: DataFrame, title: str, module: str, link, limit: int, *columns: str) -> DataFrame:
    """The page after a row: by keys, so that deep pages need no full sort."""
    key = F.struct(ascii_lower(F.col("title")).alias("t"), F.col("module_id").alias("m"), F.col("link").alias("l"))
    last = F.struct(ascii_lower(F.lit(title)).alias("t"), F.lit(module).alias("m"), F.lit(link).alias("l"))
    return page(rows.where(key > last), 0, limit, *columns)


def facets(rows: DataFrame) -> DataFrame:
    """Counts of each genre, status, format and module: one pass explodes a row into its facet values."""
    pair = lambda f, v: F.struct(F.lit(f).alias("facet"), v.alias("value"))
    genres = F.transform(F.array_distinct(split_csv(F.col("genres"))), lambda g: pair("genre", g))
    rest = F.array(pair("status", F.col("status")), pair("format", known("format")), pair("module", F.col("module_id")))
    one = rows.select(F.explode(F.concat(genres, rest)).alias("f")).select("f.facet", "f.value")
    return one.groupBy("facet", "value").agg(F.count("*").alias("n"))


def summaries(listing: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows and last update per module; modules of either side appear."""
    counts = listing.groupBy("module_id").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("updated_at"))
    both = counts.unionByName(updates.select("module_id", F.lit(0).cast("long").alias("n"), F.col("updated_at").cast("long")))
    return both.groupBy("module_id").agg(F.sum("n").alias("n"), F.max("updated_at").alias("updated_at"))


def prune(matches: DataFrame, listing: DataFrame, kept: DataFrame) -> DataFrame:
    """Matches whose link is neither listed nor kept in their module."""
    key = ["module_id", "link"]
    return matches.join(listing.select(*key), key, "left_anti").join(kept.select(*key), key, "left_anti")


def invalidate(covers: DataFrame, matches: DataFrame) -> DataFrame:
    """Covers that stay when ``matches`` are stored: one taken from a match goes when the series is another, null-safe;
    one taken from the site goes when there is a series. Covers without a new match stay."""
    m = matches.select("module_id", "link", F.col("series_id").alias("_new"), F.lit(True).alias("_stored"))
    d = covers.join(m, ["module_id", "link"], "left")
    stale = F.col("_stored") & (((F.col("source") == "match") & ~F.col("series_id").eqNullSafe(F.col("_new"))) | ((F.col("source") == "site") & F.col("_new").isNotNull()))
    return d.where(~F.coalesce(stale, F.lit(False))).drop("_new", "_stored")


def module_ids(*parts: DataFrame) -> DataFrame:
    """The modules that any of the relations names, each once."""
    return reduce(lambda a, b: a.unionByName(b), [p.select("module_id") for p in parts]).where("module_id IS NOT NULL").distinct()


def pending(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """Inputs whose fingerprint differs, null-safe, from the stored one."""
    s = stored.select("link", F.col("fingerprint").alias("stored"))
    return inputs.join(s, "link", "left").where(~F.col("fingerprint").eqNullSafe(F.col("stored"))).drop("stored")


def fingerprint(*columns: str) -> Column:
    """The matching inputs joined by the unit separator, hashed."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def prefix_rank(titles: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Series with a key of that prefix, shortest key first."""
    return titles.where(F.col("key").startswith(prefix)).groupBy("series").agg(F.min(F.length("key")).alias("shortest")).orderBy("shortest", "series").limit(limit)


#: Series offered for picking one by hand, at most.
MOST_PICKS = 20


def pick_search(series: DataFrame, titles: DataFrame, query: str, address: str) -> DataFrame:
    """The rows of ``series`` offered for a pick, with their ``place``: an address, a pattern whose group is the id, finds its
    series alone; a number finds its series first; then come titles that begin with the query, the shortest first."""
    query = query.strip()
    named = re.search(address, query)
    if named:
        return series.where(F.col("series") == int(named[1])).withColumn("place", F.lit(0))
    own = series.where(F.col("series") == (int(query) if re.fullmatch(r"[+-]?[0-9]{1,18}", query) else None)).withColumn("place", F.lit(0))
    keys = title_key_texts(query)
    if not keys:
        return own
    ranked = prefix_rank(titles, keys[0], MOST_PICKS)
    place = F.row_number().over(Window.orderBy("shortest", "series"))  # MOST_PICKS rows
    begun = series.join(F.broadcast(ranked.select("series", place.alias("place"))), "series")
    both = own.unionByName(begun.select(*own.columns))
    return keep_least(both, ["series"], ["place"]).orderBy("place").limit(MOST_PICKS)
