"""Comparisons and choices between relations: snapshots, runs, evictions, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folium.operators.ordered import keep_least
from folium.operators.scans import pieces, running


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that were added, changed or deleted."""
    j = old.select("path", F.col("hash").alias("_o")).join(new.select("path", F.col("hash").alias("_n")), "path", "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("_o") != F.col("_n"), "changed")
    return j.select("path", change.alias("change")).where("change IS NOT NULL")


def run_verdicts(before: DataFrame, now: DataFrame) -> DataFrame:
    """Each case of a run against the run before: pass, regression, or changed on both sides."""
    j = now.join(before.select("name", F.col("ok").alias("_was")), "name", "left")
    return j.select("name", F.when(F.col("ok"), "pass").when(F.coalesce("_was", F.lit(False)), "regression").otherwise("site-changed").alias("verdict"))


def evict(files: DataFrame, cap: int) -> DataFrame:
    """Files that go, least recently used first, until the rest fits under ``cap``: those up to which the sizes of the
    newer ones, summed over ranges of files, are more than that. A file of no known size goes like its neighbours."""
    order = [F.desc("used_at"), F.desc("path")]
    d = pieces(files.select("path", "size", "used_at"), [], order)
    return running(d, [], order, _upto=("sum", "size")).where(F.col("_upto") > cap).select("path", "size", "used_at")


def prioritised_union(parts: list[DataFrame], excluded: DataFrame) -> DataFrame:
    """Links of several sources, each url once from the first source that has it, one set of urls left out; the label is
    the host without www."""
    d = None
    for i, p in enumerate(parts):
        q = p.select("key", "url", F.lit(i).alias("priority"))
        d = q if d is None else d.unionByName(q)
    d = keep_least(d, ["key", "url"], ["priority"])
    host = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1), r"^www\.", "")
    return d.join(excluded.select("key", "url"), ["key", "url"], "left_anti").withColumn("label", host)


def freshest(stored: Column, stored_at: Column, fallback: list[Column], now: Column, hours: int) -> Column:
    """The stored value while it is recent, else the first fallback there is."""
    return F.coalesce(F.when(stored_at >= now - F.expr(f"INTERVAL {hours} HOURS"), stored), *fallback)


#: Names before a bracket that are tests of nodes, not functions.
NODE_TESTS = ("text", "node", "element", "attribute", "comment", "document-node", "processing-instruction")


def feature_of(expression: Column, css: Column) -> Column:
    """What an expression is counted under: a selector, JSON, the first function that it calls outside of quotes, or a path."""
    bare = F.regexp_replace(expression, "\"[^\"]*\"|'[^']*'", "")
    calls = F.filter(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_:.-]*)\s*\("), F.lit(1)), lambda n: ~n.isin(*NODE_TESTS))
    json = F.contains(expression, F.lit("json(")) | F.contains(expression, F.lit("jn:")) | F.contains(expression, F.lit("?"))
    return F.when(F.coalesce(css, F.lit(False)), "css selector").when(json, "json").when(F.size(calls) > 0, F.concat(F.get(calls, F.lit(0)), F.lit("()"))).otherwise("path")


def differences(left: DataFrame, right: DataFrame, key: str, feature: str) -> DataFrame:
    """Entries on which two evaluations differ, per feature."""
    j = left.join(right.withColumnRenamed("value", "_r"), key)
    return j.groupBy(feature).agg(F.count("*").alias("n"), F.count_if(~F.col("value").eqNullSafe(F.col("_r"))).alias("n_different"))


def frontier(pages: DataFrame, known: DataFrame, sorted_site: bool = False) -> DataFrame:
    """Links to add from crawled pages: not known, each once; on a sorted site nothing after the first known link."""
    first = keep_least(pages, ["module_id", "link"], ["position"])
    d = first.join(known.select("module_id", "link").distinct().withColumn("_k", F.lit(True)), ["module_id", "link"], "left")
    if sorted_site:
        stop = d.where("_k").groupBy("module_id").agg(F.min("position").alias("_stop"))
        d = d.join(stop, "module_id", "left").where(F.col("_stop").isNull() | (F.col("position") < F.col("_stop")))
    return d.where("_k IS NULL").select("module_id", "link", "position")


#: A URL's scheme, host and path, as Java regular expression groups.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"


def cookies_for(requests: DataFrame, cookies: DataFrame, now: Column) -> DataFrame:
    """``request_id, name, value, place``: the cookies that go with each of ``requests (request_id, url)``.

    ``cookies (place, name, value, domain, host_only, path, http_only, expires)``, ``expires`` null for as long as the
    session. A cookie goes with its domain's host and, unless it is for the host only, with hosts below it; with a path
    that is its own, or below it if its own ends in a slash; not once it has expired; and an http-only one with http
    and https alone. Of cookies of one name the last by ``place`` gives the value.

    Hosts are split into the domains that they lie in, and paths into those above them, so that cookies are joined by
    equality of both; those of one domain, path and name are one row before the join.
    """
    part = lambda i: F.regexp_extract("url", _URL, i)
    r = requests.select("request_id", F.lower(part(1)).alias("_scheme"), F.lower(part(2)).alias("_host"), F.when(part(3) == "", "/").otherwise(part(3)).alias("_path")).where("_scheme <> ''")
    labels, parts = F.split("_host", r"\."), F.split("_path", "/")
    domains = F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    above = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.concat(F.lit("<"), F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/")))
    r = r.select("request_id", F.col("_scheme").isin("http", "https").alias("_web"), "_host", F.concat(F.array(F.concat(F.lit("="), F.lower("_path"))), above).alias("_paths"), F.explode(F.array_distinct(domains)).alias("_domain"))
    r = r.select("request_id", "_web", (F.col("_domain") == F.col("_host")).alias("_whole"), "_domain", F.explode("_paths").alias("_path"))

    live = cookies.where((F.col("domain") != "") & (F.col("expires").isNull() | (F.col("expires") > now)))
    below = ~F.coalesce("host_only", F.lit(False)) & (F.col("domain") == F.lower("domain"))
    forms = F.array(F.concat(F.lit("="), F.lower("path")), F.when(F.endswith("path", F.lit("/")), F.concat(F.lit("<"), F.col("path"))))
    jar = live.select(F.lower("domain").alias("_domain"), F.explode(F.array_compact(forms)).alias("_path"), below.alias("_below"), F.coalesce("http_only", F.lit(False)).alias("_web_only"), "name", "value", "place")
    jar = jar.groupBy("_domain", "_path", "_below", "_web_only", "name").agg(F.max_by("value", "place").alias("value"), F.max("place").alias("_last"), F.min("place").alias("place"))
    d = r.join(jar, ["_domain", "_path"]).where((F.col("_whole") | F.col("_below")) & (~F.col("_web_only") | F.col("_web")))
    return d.groupBy("request_id", "name").agg(F.max_by("value", "_last").alias("value"), F.min("place").alias("place"))


class Refused(ValueError):
    """A snapshot that is empty or not whole, which nothing may be deleted for."""


def trusted_diff(old: DataFrame, new: DataFrame, path: str, least_share: float = 0.0) -> DataFrame:
    """:func:`snapshot_diff` against a new snapshot that is read once, written to ``path`` and let through only if it is whole.

    ``new (path, hash)`` may have a boolean ``truncated``, true on any row of a listing that was cut short. What the
    read meets is observed while it is written: no rows at all, a truncated listing, a row without path or hash, one
    path with two hashes, or fewer than ``least_share`` of the old paths refuse it, before any comparison.
    """
    seen = Observation("snapshot")
    cut_short = F.coalesce(F.col("truncated"), F.lit(False)) if "truncated" in new.columns else F.lit(False)
    marks = [F.count("*").alias("n"), F.count_if(cut_short).alias("cut"), F.count_if(F.col("path").isNull() | F.col("hash").isNull()).alias("holes")]
    new.observe(seen, *marks).select("path", "hash").write.mode("overwrite").parquet(path)
    met = seen.get
    if not met["n"]:
        raise Refused("the snapshot is empty")
    if met["cut"]:
        raise Refused("the snapshot is truncated")
    if met["holes"]:
        raise Refused(f"{met['holes']} rows of the snapshot lack path or hash")
    whole = old.sparkSession.read.parquet(path).distinct()
    rows, paths = whole.agg(F.count("*"), F.count_distinct("path")).first()
    if rows != paths:
        raise Refused("a path of the snapshot has several hashes")
    if least_share and paths < least_share * old.count():
        raise Refused(f"the snapshot has only {paths} paths")
    return snapshot_diff(old, whole)
