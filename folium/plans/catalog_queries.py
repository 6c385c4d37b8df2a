"""Catalog and resolution queries, each beside the SQL that gives its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions.text import ascii_lower, link_key, split_csv
from folium.operators import catalog, resolve
from folium.operators.ordered import keep_one
from folium.schemas import LISTING_SQL, MATCHES_SQL, listing, matches, table
from folium.shared import scratch
from folium.sources import io
from folium.sources.search_index import SearchIndex

PAGE = ("module_id", "link", "title")
_FTS = r"' ' || trim(regexp_replace(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _fts(prefix: str) -> str:
    return f"(contains({_FTS.format(c='title')}, ' {prefix}') OR contains({_FTS.format(c='alttitles')}, ' {prefix}'))"


_ORDER = "ORDER BY lower(title), module_id, link"
_JOINED = f"{LISTING_SQL} l LEFT JOIN {MATCHES_SQL} m USING (module_id, link)"


def search_everything(spark, sf):
    return catalog.page(listing(spark, sf), 0, 50, *PAGE)


def search_module(spark, sf):
    return catalog.page(catalog.where(listing(spark, sf), modules=["Brand#11"]), 0, 50, *PAGE)


def search_deep_page(spark, sf):
    return catalog.page(listing(spark, sf), 500, 50, *PAGE)


def search_prefix_page(spark, sf):
    rows = catalog.where(catalog.matched(listing(spark, sf), matches(spark, sf)), query="st", format="unknown")
    return catalog.page(rows.withColumn("format", catalog.known("format")), 0, 50, *PAGE, "format")


def search_two_terms(spark, sf):
    return catalog.page(catalog.where(listing(spark, sf), query='"SMALL ri'), 0, 50, *PAGE)


def search_short_prefix(spark, sf):
    return catalog.where(listing(spark, sf), query="e").agg(F.count("*").alias("total"))


def search_include_exclude(spark, sf):
    return catalog.page(catalog.where(listing(spark, sf), include=("promo",), exclude=("brand#1",), status="1"), 0, 50, *PAGE)


def search_term_and_filters(spark, sf):
    return catalog.page(catalog.where(listing(spark, sf), query="st", exclude=("brand#1",), status="1"), 0, 50, *PAGE)


def index_search(spark, sf):
    """A search of two words through the index on disk."""
    rows = listing(spark, sf)
    index = SearchIndex(spark, scratch(spark, "index"), rows)
    index.replace(rows)
    return index.search('"SMALL ri').select(*PAGE)


def index_upkeep(spark, sf):
    """Searches through the index after one module was replaced by fewer rows of other titles, and one was emptied."""
    rows = listing(spark, sf)
    index = SearchIndex(spark, scratch(spark, "index"), rows)
    index.replace(rows)
    later = rows.where("module_id = 'Brand#11' AND link % 2 = 0").withColumn("title", F.concat(F.lit("Nouvelle "), "title"))
    index.replace(later, ["Brand#11", "Brand#7"])
    found = [index.search(q, m).select(*PAGE) for q, m in (("nouv", None), ("st", ["Brand#11", "Brand#12"]), ("", ["Brand#7", "Brand#11", "Brand#8"]))]
    return found[0].withColumn("search", F.lit("word")).unionByName(found[1].withColumn("search", F.lit("modules"))).unionByName(found[2].withColumn("search", F.lit("all")))


def pick_search(spark, sf):
    """Series to pick by hand, by an address, by a number, and by the beginning of a title."""
    p = table(spark, sf, "part")
    series = p.select(F.col("p_partkey").alias("series"), F.col("p_name").alias("title"))
    titles = p.select(F.concat(F.lower("p_name"), F.when(F.col("p_size") % 2 == 0, F.lit(" too")).otherwise(F.lit(""))).alias("key"), F.col("p_partkey").alias("series"))
    titles = titles.unionByName(p.select(F.concat((F.col("p_partkey") % 50).cast("string"), F.lit(" "), F.lower("p_name")).alias("key"), F.col("p_partkey").alias("series")))
    out = None
    for query in (" https://site.org/series/17/red ", "12", "  Small (colored) ", "999999999", "..."):
        one = catalog.pick_search(series, titles, query, r"site\.org/series/(\d+)").withColumn("query", F.lit(query))
        out = one if out is None else out.unionByName(one)
    return out


def facet_counts(spark, sf):
    return catalog.facets(catalog.matched(listing(spark, sf), matches(spark, sf)))


def facet_counts_term(spark, sf):
    return catalog.facets(catalog.where(catalog.matched(listing(spark, sf), matches(spark, sf)), query="st"))


def _facets_sql(where: str) -> str:
    return f"""WITH r AS (SELECT * FROM {_JOINED} WHERE {where}),
    f AS (SELECT 'genre' facet, unnest(list_distinct(list_filter(list_transform(string_split(genres, ','), lambda x: trim(x)), lambda x: x <> ''))) AS value FROM r
      UNION ALL SELECT 'status', status FROM r UNION ALL SELECT 'format', CASE WHEN series_id IS NULL THEN 'unknown' ELSE format END FROM r UNION ALL SELECT 'module', module_id FROM r)
    SELECT facet, value, count(*) n FROM f GROUP BY ALL"""


def list_summaries(spark, sf):
    updates = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("module_id")).agg(F.max(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("updated_at"))
    return catalog.summaries(listing(spark, sf), updates)


def prune_unlisted(spark, sf):
    kept = table(spark, sf, "part").where("p_size = 7").select(F.col("p_brand").alias("module_id"), F.col("p_partkey").alias("link"))
    return catalog.prune(catalog.accepted(matches(spark, sf)), listing(spark, sf).where("status <> '0'"), kept).select("link", "series_id")


def pending_by_fingerprint(spark, sf):
    inputs = listing(spark, sf).select("link", catalog.fingerprint("title", "alttitles", "link").alias("fingerprint"))
    stored = inputs.where("link % 3 <> 0").select("link", F.when(F.col("link") % 7 == 0, F.lit("old")).when(F.col("link") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return catalog.pending(inputs, stored)


def title_prefix_rank(spark, sf):
    return catalog.prefix_rank(table(spark, sf, "part").select(F.lower("p_name").alias("key"), F.col("p_partkey").alias("series")), "bl")


def pick_search(spark, sf):
    """The id that a text names first, then titles by prefix, each series once, at most 20."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("series"), F.col("p_name").alias("title"))
    by_id = parts.where("series = 42").withColumn("priority", F.lit(0))
    by_title = parts.where(F.startswith(ascii_lower(F.col("title")), F.lit("s"))).withColumn("priority", F.lit(1))
    return keep_one(by_id.unionByName(by_title), [F.col("series")], [F.col("priority")]).orderBy("priority", F.length("title"), "series").limit(20)


def upsert_rows(spark, sf):
    old = listing(spark, sf).select("link", "title").where("link % 2 = 0")
    new = listing(spark, sf).where("link % 3 = 0").select("link", F.upper("title").alias("title"))
    return io.upsert(old, new, ["link"])


def insert_absent(spark, sf):
    o = table(spark, sf, "lineitem")
    return io.absent(o.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey"), o.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"])


def keep_first(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return keep_one(d, [F.col("l_orderkey"), F.col("l_linenumber")], [F.col("l_partkey"), F.col("l_quantity")])


def keep_last(spark, sf):
    d = table(spark, sf, "events").select("user_id", F.lower("event_type").alias("kind"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return keep_one(d, [F.col("user_id"), F.col("kind")], [F.desc("ts"), F.desc("event_id")])


def _chain(spark, sf):
    return table(spark, sf, "documents").where("doc_id > 0").select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).cast("long").alias("dst"))


def merge_chain_final(spark, sf):
    return resolve.merge_chain(_chain(spark, sf))


def repointed_keys(spark, sf):
    keys = table(spark, sf, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("series"))
    return resolve.repoint(keys, resolve.merge_chain(_chain(spark, sf).where("src > 3")))


def resolve_decide(spark, sf):
    """Part names against a catalog of their own, people by type; candidates over the cap are ambiguous."""
    p = table(spark, sf, "part")
    inputs = p.select(F.col("p_partkey").alias("link"), F.array(F.lower("p_name")).alias("keys"), F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("people"))
    series = p.where("p_size < 40").select(F.col("p_partkey").alias("series"), F.array(F.lower("p_name")).alias("main_keys"), F.array("p_type").alias("people"), F.when(F.col("p_size") < 5, F.lit("novel")).alias("type"))
    titles = series.select(F.explode("main_keys").alias("key"), "series")
    found = resolve.decide(inputs, titles, series, most=25)
    return found.groupBy("confidence").agg(F.count("*").alias("n"))


def cross_ids(spark, sf):
    """Ids on other sites, exploded from a map, joined by (site, id)."""
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("link"), F.create_map(F.lit("al"), F.col("c_nationkey").cast("string"), F.lit("mu"), (F.col("c_custkey") % 40).cast("string")).alias("ids"))
    mine = d.select("link", F.explode("ids").alias("site", "xid"))
    theirs = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.lit("al")).otherwise(F.lit("mu")).alias("site"), (F.col("s_suppkey") % 60).cast("string").alias("xid"), F.col("s_suppkey").alias("series"))
    return resolve.series_of_ids(mine, theirs)


def link_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", link_key(F.concat(F.lit("https://x.org/viewer?title_no="), F.col("p_partkey").cast("string"), F.lit("&page="), F.col("p_size").cast("string"))).alias("key"))


def csv_people(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(split_csv(F.concat_ws(" , ", "p_brand", F.lit(""), "p_type")), "|").alias("people"))


Q, S = {}, {}
for _f, _sql in (
    (search_everything, f"SELECT module_id, link, title FROM {LISTING_SQL} {_ORDER} LIMIT 50"),
    (search_module, f"SELECT module_id, link, title FROM {LISTING_SQL} WHERE module_id = 'Brand#11' {_ORDER} LIMIT 50"),
    (search_deep_page, f"SELECT module_id, link, title FROM {LISTING_SQL} {_ORDER} LIMIT 50 OFFSET 500"),
    (search_prefix_page, f"SELECT module_id, link, title, 'unknown' AS format FROM {_JOINED} WHERE {_fts('st')} AND CASE WHEN series_id IS NULL THEN 'unknown' ELSE format END = 'unknown' {_ORDER} LIMIT 50"),
    (search_two_terms, f"SELECT module_id, link, title FROM {LISTING_SQL} WHERE {_fts('small')} AND {_fts('ri')} {_ORDER} LIMIT 50"),
    (search_short_prefix, f"SELECT count(*) total FROM {LISTING_SQL} WHERE {_fts('e')}"),
    (search_include_exclude, f"SELECT module_id, link, title FROM {LISTING_SQL} WHERE contains(lower(genres), 'promo') AND NOT contains(lower(genres), 'brand#1') AND status = '1' {_ORDER} LIMIT 50"),
    (search_term_and_filters, f"SELECT module_id, link, title FROM {LISTING_SQL} WHERE {_fts('st')} AND NOT contains(lower(genres), 'brand#1') AND status = '1' {_ORDER} LIMIT 50"),
    (facet_counts, _facets_sql("true")),
    (facet_counts_term, _facets_sql(_fts("st"))),
    (list_summaries, "WITH u AS (SELECT p_brand module_id, max(epoch(l_shipdate))::BIGINT updated_at FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT module_id, sum(n)::BIGINT n, max(updated_at) updated_at FROM (SELECT p_brand module_id, count(*) n, NULL::BIGINT updated_at FROM part GROUP BY 1 UNION ALL SELECT module_id, 0, updated_at FROM u) GROUP BY 1"),
    (prune_unlisted, f"SELECT link, series_id FROM {MATCHES_SQL} WHERE link NOT IN (SELECT p_partkey FROM part WHERE p_size % 4 <> 0) AND link NOT IN (SELECT p_partkey FROM part WHERE p_size = 7)"),
    (pending_by_fingerprint, f"WITH i AS (SELECT link, md5(title || chr(31) || alttitles || chr(31) || link) fingerprint FROM {LISTING_SQL}), s AS (SELECT link, CASE WHEN link % 7 = 0 THEN 'old' WHEN link % 11 = 0 THEN NULL ELSE fingerprint END old FROM i WHERE link % 3 <> 0) SELECT link, fingerprint FROM i LEFT JOIN s USING (link) WHERE fingerprint IS DISTINCT FROM old"),
    (index_search, f"SELECT module_id, link, title FROM {LISTING_SQL} WHERE {_fts('small')} AND {_fts('ri')}"),
    (
        index_upkeep,
        f"""WITH l AS (SELECT * REPLACE (CASE WHEN module_id = 'Brand#11' THEN 'Nouvelle ' || title ELSE title END AS title) FROM {LISTING_SQL} WHERE module_id <> 'Brand#7' AND (module_id <> 'Brand#11' OR link % 2 = 0))
        SELECT module_id, link, title, 'word' AS search FROM l WHERE {_fts('nouv')} UNION ALL SELECT module_id, link, title, 'modules' FROM l WHERE module_id IN ('Brand#11', 'Brand#12') AND {_fts('st')} UNION ALL SELECT module_id, link, title, 'all' FROM l WHERE module_id IN ('Brand#11', 'Brand#8')""",
    ),
    (
        pick_search,
        """WITH t AS (SELECT lower(p_name) || CASE WHEN p_size % 2 = 0 THEN ' too' ELSE '' END k, p_partkey s FROM part UNION ALL SELECT p_partkey % 50 || ' ' || lower(p_name), p_partkey FROM part),
        r AS (SELECT s, min(length(k)) n, row_number() OVER (ORDER BY min(length(k)), s) i FROM t WHERE starts_with(k, '12') GROUP BY s ORDER BY n, s LIMIT 20),
        n AS (SELECT 12 s, 0 i UNION ALL SELECT s, i FROM r WHERE s <> 12 ORDER BY i LIMIT 20),
        w AS (SELECT s, row_number() OVER (ORDER BY min(length(k)), s) i FROM t WHERE starts_with(k, 'small colored') GROUP BY s ORDER BY min(length(k)), s LIMIT 20)
        SELECT p_partkey AS series, p_name title, i::INT place, q AS query FROM (SELECT 17 s, 0 i, ' https://site.org/series/17/red ' q UNION ALL SELECT s, i, '12' FROM n UNION ALL SELECT s, i, '  Small (colored) ' FROM w) JOIN part ON p_partkey = s""",
    ),
    (title_prefix_rank, "SELECT p_partkey series, min(length(p_name))::INT shortest FROM part WHERE starts_with(lower(p_name), 'bl') GROUP BY 1 ORDER BY 2, 1 LIMIT 20"),
    (pick_search, "SELECT series, title, min(priority)::INT priority FROM (SELECT p_partkey series, p_name title, 0 priority FROM part WHERE p_partkey = 42 UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE starts_with(lower(p_name), 's')) GROUP BY 1, 2 ORDER BY 3, length(title), series LIMIT 20"),
    (upsert_rows, "SELECT p_partkey link, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END title FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"),
    (insert_absent, "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'"),
    (keep_first, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) n FROM lineitem) WHERE n = 1"),
    (keep_last, "SELECT user_id, kind, event_id, ts FROM (SELECT user_id, lower(event_type) kind, event_id, epoch_us(ts) // 1000 ts, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) n FROM events) WHERE n = 1"),
    (merge_chain_final, "WITH RECURSIVE e AS (SELECT doc_id src, doc_id // 2 dst FROM documents WHERE doc_id > 0), c AS (SELECT src, dst, 1 depth FROM e UNION ALL SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON e.src = c.dst WHERE depth < 32) SELECT src, arg_max(dst, depth) dst, max(depth)::INT depth FROM c GROUP BY 1"),
    (repointed_keys, "WITH RECURSIVE e AS (SELECT doc_id src, doc_id // 2 dst FROM documents WHERE doc_id > 3), c AS (SELECT src, dst, 1 depth FROM e UNION ALL SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON e.src = c.dst WHERE depth < 32), f AS (SELECT src, arg_max(dst, depth) dst FROM c GROUP BY 1) SELECT DISTINCT source AS key, coalesce(dst, doc_id) series FROM documents LEFT JOIN f ON src = doc_id"),
    (
        resolve_decide,
        """WITH i AS (SELECT p_partkey link, lower(p_name) k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END person FROM part),
        s AS (SELECT p_partkey series, lower(p_name) k, p_type person, p_size < 5 novel FROM part WHERE p_size < 40),
        c AS (SELECT link, i.person, s.person theirs, series, novel, count(*) OVER (PARTITION BY link) total FROM i JOIN s USING (k)),
        a AS (SELECT link, any_value(total) total, count(*) FILTER (WHERE NOT novel) n,
          count(*) FILTER (WHERE NOT novel AND person = theirs) agree FROM c GROUP BY 1)
        SELECT CASE WHEN total > 25 THEN 'ambiguous' WHEN coalesce(n, 0) = 0 THEN 'none' WHEN person IS NULL AND n = 1 THEN 'title-unique' WHEN person IS NULL THEN 'ambiguous'
          WHEN agree = 0 THEN 'author-conflict' WHEN agree = 1 THEN 'title+author' ELSE 'ambiguous' END confidence, count(*) n FROM i LEFT JOIN a USING (link) GROUP BY 1""",
    ),
    (cross_ids, "WITH m AS (SELECT c_custkey link, 'al' site, c_nationkey::VARCHAR xid FROM customer UNION ALL SELECT c_custkey, 'mu', (c_custkey % 40)::VARCHAR FROM customer), t AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'al' ELSE 'mu' END site, (s_suppkey % 60)::VARCHAR xid, s_suppkey series FROM supplier) SELECT link, count(DISTINCT series) n_series, min(series) first_series FROM m JOIN t USING (site, xid) GROUP BY 1"),
    (link_keys, "SELECT p_partkey, regexp_extract('https://x.org/viewer?title_no=' || p_partkey || '&page=' || p_size, 'title_no=(\\d+)', 1) AS key FROM part"),
    (csv_people, "SELECT p_partkey, p_brand || '|' || p_type people FROM part"),
):
    Q[_f.__name__], S[_f.__name__] = _f, _sql
