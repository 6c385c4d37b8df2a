"""Clean-up of what a site says about a series: each field by its own rule, and its chapters as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.clean import common_filter, url_parts
from folium.functions.text import ascii_lower, control_trim


def drop_marks(c: Column) -> Column:
    """Without no-break spaces and byte order marks."""
    return F.regexp_replace(c, "[\\u00a0\\ufeff]", "")


def drop_breaks(c: Column) -> Column:
    """Without line breaks, written out as ``\\n`` and ``\\r`` too."""
    return F.replace(F.replace(F.regexp_replace(c, "[\\r\\n]", ""), F.lit("\\n"), F.lit("")), F.lit("\\r"), F.lit(""))


def one_line(c: Column) -> Column:
    """Line breaks and tabs as spaces, runs of spaces as one."""
    return control_trim(F.regexp_replace(F.regexp_replace(control_trim(c), "[\\r\\n\\t]", " "), " {2,}", " "))


def many_lines(c: Column) -> Column:
    """Runs of line breaks as one."""
    return F.regexp_replace(F.regexp_replace(control_trim(c), "(\r\n){2,}", "\r\n"), "\n{2,}", "\n")


def clean_address(c: Column) -> Column:
    """Without a leading colon and slashes, slashes right after the scheme, and doubled ones elsewhere."""
    bare = F.regexp_replace(F.regexp_replace(control_trim(c), "^:", ""), "^//", "")
    scheme, rest = F.regexp_extract(bare, r"(?s)^(.*?://)", 1), F.regexp_replace(bare, r"(?s)^(.*?://)/*", "")
    return F.concat(scheme, F.regexp_replace(rest, "([^:])/{2,}", "$1/"))


def _text(c: Column) -> Column:
    return control_trim(drop_marks(drop_breaks(common_filter(c))))


def _names(c: Column) -> Column:
    return F.regexp_replace(control_trim(drop_marks(control_trim(drop_marks(drop_breaks(control_trim(c)))))), ",+$", "")


def _placeholder(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("<")) | c.isin("-", ":"), "").otherwise(c)


FIELDS = ("url", "link", "title", "alt_titles", "cover_link", "authors", "artists", "genres", "status", "summary")


def clean_series(rows: DataFrame) -> DataFrame:
    """``rows`` with its ten FIELDS cleaned; nulls count as empty. A series without a title is ``N/A``; markup or a lone
    dash or colon counts as no value; a series without a link has the path of its address."""
    d = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in FIELDS else F.col(f"`{c}`") for c in rows.columns])
    summary = many_lines(drop_marks(F.col("summary")))
    cleaned = {
        "link": F.when(F.col("link") == "", url_parts(F.col("url"))["path"]).otherwise(F.col("link")),
        "title": F.when(_text(F.col("title")) == "", "N/A").otherwise(_text(F.col("title"))),
        "alt_titles": _placeholder(_text(F.col("alt_titles"))),
        "cover_link": clean_address(F.col("cover_link")),
        "authors": _placeholder(_names(F.col("authors"))),
        "artists": _placeholder(_names(F.col("artists"))),
        "genres": _names(F.col("genres")),
        "summary": F.when(summary.isin("-", ":"), "").otherwise(summary),
    }
    return d.select(*[cleaned[c].alias(c) if c in cleaned else F.col(f"`{c}`") for c in d.columns])


def chapters_of(rows: DataFrame, key: str, drop_title: bool = False) -> DataFrame:
    """``key, position, link, name`` of the chapters of ``rows (key, title, chapter_links, chapter_names)``, in order from 0.

    Links without a name have an empty one. Of links that are equal but for ASCII case the last stays; links lose their
    host, and those of which nothing is left go. With ``drop_title``, names lose the series' title before them.
    """
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    named = F.transform(some("chapter_links"), lambda x, i: F.struct(control_trim(F.coalesce(x, F.lit(""))).alias("link"), control_trim(F.coalesce(F.get(some("chapter_names"), i), F.lit(""))).alias("name")))
    d = rows.select(F.col(key).alias("_key"), F.coalesce("title", F.lit("")).alias("_title"), F.posexplode(named).alias("_at", "_c")).select("_key", "_title", "_at", "_c.link", "_c.name")
    last = d.groupBy("_key", ascii_lower(F.col("link")).alias("_l")).agg(F.max_by(F.struct("_title", "_at", "link", "name"), "_at").alias("_r")).select("_key", "_r.*")
    d = last.withColumn("link", url_parts(F.col("link"))["path"]).where("link <> ''")
    d = d.withColumn("name", control_trim(one_line(drop_breaks(common_filter(F.col("name"))))))
    if drop_title:
        rest = control_trim(F.substr("name", F.length("_title") + 1))
        rest = F.when(F.startswith(rest, F.lit("- ")), F.substr(rest, F.lit(3))).otherwise(rest)
        begins = (F.col("_title") != "") & (F.length("name") > F.length("_title")) & F.startswith(ascii_lower(F.col("name")), ascii_lower(F.col("_title")))
        d = d.withColumn("name", F.when(begins, rest).otherwise(F.col("name")))
    # one series' chapters
    line = d.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_at", "link", "name"))).alias("_r"))
    return line.select(F.col("_key").alias(key), F.posexplode("_r").alias("position", "_r")).select(key, "position", "_r.link", "_r.name")


#: How a series' kind and rating are told in book metadata.
READING = {"manga": "YesAndRightToLeft", "manhwa": "Yes", "manhua": "Yes", "oel": "No"}
RATING = {"safe": "Everyone", "suggestive": "Teen", "erotica": "Mature 17+", "pornographic": "Adults Only 18+"}


def _named(c: Column, names: dict[str, str]) -> Column:
    out = F.when(c == "", None)
    for value, name in names.items():
        out = out.when(c == value, name)
    return out.when(c.isNotNull(), "Unknown")


def reading_direction(kind: Column) -> Column:
    """Right to left for one kind only; null where no kind is given."""
    return _named(kind, READING)


def age_rating(rating: Column) -> Column:
    """Null where no rating is given."""
    return _named(rating, RATING)


def year_text(year: Column) -> Column:
    """Four digits, or empty for a year that they cannot hold."""
    return F.when(year.between(1, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise("")
