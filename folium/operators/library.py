"""Library analytics: new and unseen items, rule groups, tags, formats, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import distinct_ci, strip_marks
from folium.operators import scans

#: File kinds in the order that breaks ties.
FORMATS = ("folder", "cbz", "zip", "pdf", "epub")
FAILING, PAUSE_HOURS = 3, 24


def unseen(favorites: DataFrame, chapters: DataFrame, seen: DataFrame) -> DataFrame:
    """Per favorite its chapters, the unseen ones, and known-minus-listed held at zero. Keys compare without case."""
    marks = seen.select("favorite_id", F.lower("link").alias("_k")).distinct().withColumn("_seen", F.lit(1))
    c = chapters.withColumn("_k", F.lower("link")).join(marks, ["favorite_id", "_k"], "left")
    n = c.groupBy("favorite_id").agg(F.count("*").alias("n_chapters"), F.count_if(F.col("_seen").isNull()).alias("n_new"))
    return favorites.join(n, "favorite_id", "left").select("favorite_id", F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), F.coalesce("n_new", F.lit(0)).alias("n_new"), F.greatest(F.col("known") - F.coalesce("n_chapters", F.lit(0)), F.lit(0)).alias("n_behind"))


def new_items(site: DataFrame, downloaded: DataFrame) -> DataFrame:
    """Listed items that were not downloaded, positions kept."""
    return site.withColumn("_k", F.lower("link")).join(downloaded.select("favorite_id", F.lower("link").alias("_k")).distinct(), ["favorite_id", "_k"], "left_anti").drop("_k")


def first_rule(rows: DataFrame, rules: DataFrame, key: str, test: Column) -> DataFrame:
    """Each row with the first rule, by sort_order, that holds for it; none gives null. ``rules`` is a user's short list,
    so each row meets each rule in place: the rules become one array literal column."""
    listed = rules.orderBy("sort_order").collect()  # a person's own groups
    pick = F.coalesce(*[F.when(test(F.lit(r["rule_kind"]), F.lit(r["rule_value"])), F.lit(r["group_id"])) for r in listed], F.lit(None).cast("int"))
    return rows.select(key, pick.alias("group_id"))


def tag_union(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Tags of several columns in order, a later spelling of an earlier tag dropped."""
    return rows.select(key, distinct_ci(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])).alias("tags"))


def tag_facets(rows: DataFrame, tags: str, order: str) -> DataFrame:
    """Rows per tag, case ignored, under the spelling that comes first."""
    t = rows.select(order, F.posexplode(tags).alias("_p", "tag"))
    return t.groupBy(F.lower("tag").alias("folded")).agg(F.min_by("tag", F.struct(order, "_p")).alias("tag"), F.countDistinct(order).alias("n")).select("tag", "n")


def format_facets(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows per format with its place in the given order; formats that it lacks are last."""
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("format"))
    n = rows.groupBy(F.coalesce("format", F.lit("unknown")).alias("format")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int")).orderBy("place", "format")


def site_counts(rows: DataFrame, site: str, name: str) -> DataFrame:
    """Rows per site under its first name, by name."""
    return rows.groupBy(site).agg(F.min(name).alias(name), F.count("*").alias("n")).orderBy(name, site)


def majority_format(files: DataFrame, key: str) -> DataFrame:
    """The commonest file kind, ties by FORMATS."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))
    n = files.groupBy(key, "format").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by("format", F.struct("n", -rank)).alias("format"))


def eligible(rows: DataFrame, now: Column) -> DataFrame:
    """Enabled, with a link, and not failing again within a day of the last failure."""
    failing = (F.col("failures") >= FAILING) & (F.col("last_failure") > now - F.expr(f"INTERVAL {PAUSE_HOURS} HOURS"))
    return rows.where(F.col("enabled") & (F.trim(F.coalesce("link", F.lit(""))) != "") & ~F.coalesce(failing, F.lit(False)))


def chip(name: str) -> Column:
    """The library's quick filters."""
    return {
        "all": F.lit(True),
        "new": F.col("n_new") > 0,
        "ongoing": F.col("status") == "1",
        "completed": F.col("status") == "0",
        "disabled": ~F.col("enabled"),
        "failing": F.col("failures") >= FAILING,
    }[name]


def tags_match(tags: str, include: list[str], exclude: list[str]) -> Column:
    """Whole tags, case ignored: all of these, none of those."""
    low = F.transform(tags, lambda x: F.lower(x))
    out = F.lit(True)
    for t in include:
        out = out & F.array_contains(low, t.lower())
    for t in exclude:
        out = out & ~F.array_contains(low, t.lower())
    return out


def sections(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows under their groups in the groups' order, unknown groups as ungrouped (last), empty groups left out. Sections
    are numbered by ranges, so that one of any size will do."""
    g = groups.select("group_id", "group_name", "sort_order")
    d = rows.join(g, "group_id", "left").withColumn("section", F.coalesce("group_name", F.lit("Ungrouped")))
    d = d.select("section", F.coalesce("sort_order", F.lit(2_147_483_647)).alias("section_order"), key)
    return scans.numbered(d, [key], "place", ["section"]).withColumn("place", (F.col("place") + 1).cast("int"))


def distinct_chapters(chapters: DataFrame, key: str, link: str) -> DataFrame:
    """Chapters of each key, links that differ in case or outer blanks once."""
    return chapters.groupBy(key).agg(F.countDistinct(F.lower(F.trim(link))).alias("n_chapters"))


def credits(rows: DataFrame, key: str) -> DataFrame:
    """One row per person of a work, with the roles in the order in which they are given."""
    d = rows.groupBy(key, F.lower("person").alias("_p")).agg(F.min_by("person", "place").alias("person"), F.min("place").alias("place"), F.sort_array(F.collect_set(F.struct("place", "role"))).alias("_r"))  # one person's roles
    return d.select(key, "person", F.array_join(F.array_distinct(F.transform("_r", lambda x: x["role"])), ", ").alias("roles"), "place")


def modules_of_hosts(rows: DataFrame, host: str, modules: DataFrame) -> DataFrame:
    """``rows`` with ``module_id``: the last module whose root address holds the host, else the host without its first
    four letters where it has a w in it; null for none.

    A root's substrings of the lengths that occur among hosts are made, so that the join is by equality.
    """
    low = F.lower(host)
    want = rows.select(F.col(host).alias("_h"), low.alias("_low")).distinct().where("_low <> ''")
    forms = F.array_compact(F.array(F.struct(F.lit(0).alias("p"), F.col("_low").alias("s")), F.when(F.contains("_low", F.lit("w")) & (F.length("_low") > 4), F.struct(F.lit(1).alias("p"), F.substr("_low", F.lit(5)).alias("s")))))
    want = want.select("_h", F.explode(forms).alias("_f")).select("_h", "_f.p", "_f.s")
    sizes = want.select(F.length("s").alias("_n")).distinct()  # as many as hosts have lengths
    held = modules.join(F.broadcast(sizes), F.col("_n") <= F.length("root_url")).select("module_id", F.explode(F.sequence(F.lit(1), F.length("root_url") - F.col("_n") + 1)).alias("_i"), "root_url", "_n")
    held = held.select("module_id", F.substring("root_url", F.col("_i"), F.col("_n")).alias("s")).groupBy("s").agg(F.max("module_id").alias("module_id"))
    found = want.join(held, "s").groupBy("_h").agg(F.min_by("module_id", "p").alias("module_id"))
    return rows.join(found, rows[host] == F.col("_h"), "left").drop("_h")


def numbered(position: Column, name: Column) -> Column:
    """A name behind its position in four digits, or in all of them where there are more."""
    digits = position.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")), F.lit(" "), name)


def missing_files(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """Chapters without a file under their own name or their numbered one."""
    names = chapters.withColumn("_n", F.explode(F.array(F.col("name"), numbered(F.col("position"), F.col("name")))))
    there = names.join(files.select("favorite_id", F.col("file").alias("_n")), ["favorite_id", "_n"], "left_semi").select("favorite_id", "position")
    return chapters.join(there, ["favorite_id", "position"], "left_anti")


#: How a library is sorted.
SORTS = ("library", "title", "new", "updated", "added")


def sorted_favorites(rows: DataFrame, by: str) -> DataFrame:
    """Favorites by title (case and marks ignored), by most new chapters, or by newest update or addition, those without
    a time last; ties, and ``library`` itself, in library order. Columns: sort_order, display_title, new_chapters,
    last_updated, date_added."""
    if by not in SORTS:
        raise ValueError(f"no such sort: {by}")
    keys = {
        "library": [],
        "title": [F.lower(strip_marks(F.col("display_title")))],
        "new": [F.desc("new_chapters")],
        "updated": [F.desc_nulls_last("last_updated")],
        "added": [F.desc_nulls_last("date_added")],
    }
    return rows.orderBy(*keys[by], "sort_order")


def grouped_modules(modules: DataFrame) -> DataFrame:
    """``place, category, label, module_id`` of ``modules (module_id, name, category, root_url)``: categories in order and
    their modules by name, case and marks ignored, those of one name by host; a name that several have is told with its
    host. Modules without a category are under ``Other``."""
    host = F.lower(F.regexp_extract(F.coalesce("root_url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    fold = lambda c: F.lower(strip_marks(F.coalesce(c, F.lit(""))))
    d = modules.withColumn("category", F.when(F.coalesce("category", F.lit("")) == "", "Other").otherwise(F.col("category"))).withColumn("_host", host)
    d = d.withColumn("_c", fold("category")).withColumn("_n", fold("name"))
    repeated = d.groupBy(F.col("name").alias("_name")).agg(F.count("*").alias("_times")).where("_times > 1").select("_name")
    d = d.join(repeated, F.col("name") == F.col("_name"), "left")
    d = scans.numbered(d, ["_c", "category", "_n", "_host", "module_id"], "place")
    label = F.when(F.col("_name").isNotNull(), F.concat("name", F.lit(" ("), "_host", F.lit(")"))).otherwise(F.col("name"))
    return d.select("place", "category", label.alias("label"), "module_id")
