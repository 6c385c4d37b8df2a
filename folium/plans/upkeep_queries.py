"""Queries of resolution tiers, invalidation, addresses, clean-up, queue upkeep and failure state, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import clean, names
from folium.operators import catalog, library, ordered, queue, rematch, resolve
from folium.schemas import LISTING_SQL, MATCHES_SQL, listing, matches, spread, table
from folium.shared import scratch
from folium.streaming import events as streams
from folium.streaming import stateful


def resolve_tiers(spark, sf):
    """Parts by a site link, ids on other sites, then name and people: whole tables in every tier."""
    p = table(spark, sf, "part")
    n = F.col("p_partkey")
    site = F.array(F.concat(F.lit("a"), (n % 3).cast("string"), F.lit(":"), n.cast("string")), F.lit("none"))
    inputs = p.select(
        n.alias("link"),
        F.when(n % 4 == 0, n.cast("string")).alias("link_key"),
        F.when(n % 3 == 0, site).otherwise(F.array().cast("array<string>")).alias("xids"),
        F.array(F.concat_ws(" ", F.lower("p_name"), (n % 7).cast("string"))).alias("keys"),
        F.array("p_type").alias("people"),
    )
    series = p.where("p_size < 30").select(n.alias("series"), F.array(F.concat_ws(" ", F.lower("p_name"), (n % 7).cast("string"))).alias("main_keys"), F.array("p_type").alias("people"), F.lit(None).cast("string").alias("type"))
    links = p.select(F.explode(F.array(n, (n + 4) * (n % 2))).alias("key"), n.alias("series")).select(F.col("key").cast("string").alias("key"), "series")
    xids = table(spark, sf, "lineitem").select(F.concat(F.lit("a0:"), F.col("l_partkey").cast("string")).alias("key"), (F.col("l_partkey") + F.col("l_suppkey") % 2 * (F.col("l_partkey") % 2)).alias("series"))
    found = resolve.decide(inputs, series.select(F.explode("main_keys").alias("key"), "series"), series, most=25, links=links, xids=xids)
    return found.select("link", "confidence", "series_id")


def _rematch_tables(spark, sf, run):
    """Listing, favorites, picks, catalog and build of a run: the second one is retitled and has lost links, the third one has another build."""
    p = table(spark, sf, "part")
    n = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", F.when(F.col("p_size") < 25, n).otherwise(n % 2).cast("string"))
    row = [F.col("p_brand").alias("module_id"), n.alias("link"), title.alias("title"), F.lit("").alias("alttitles"), F.col("p_type").alias("authors"), F.lit(None).cast("string").alias("artists")]
    first = p.select(*row)
    later = p.where(n % 11 != 0).select(*row[:2], F.when(n % 7 == 0, F.concat("p_name", F.lit(" 1"))).otherwise(title).alias("title"), *row[3:])
    series = p.where(F.col("p_size") < (40 if run < 3 else 35)).select(n.alias("series"), F.array(title).alias("main_keys"), F.array(F.lower("p_type")).alias("people"), F.when(F.col("p_size") < 5, "novel").otherwise("manhwa").alias("type"), F.when(F.col("p_size") % 2 == 0, "releasing").otherwise("upcoming").alias("status"), (F.col("p_size") + 1980).alias("year"))
    favorites = first.where(F.col("link") % 22 == 0)
    picked = p.where(n % 13 == 0).select(*row[:2], (n + 1).alias("series_id"))
    catalog = {"series": series, "titles": series.select(F.explode("main_keys").alias("key"), "series")}
    return first if run == 1 else later, favorites, picked, catalog, "b1" if run < 3 else "b2"


def _rematched(spark, sf, runs):
    log = None
    for run in range(1, runs + 1):
        tables = _rematch_tables(spark, sf, run)
        log = log or rematch.match_log(spark, scratch(spark, "matches"), tables[0])
        rematch.rematch(log, run, *tables)
    return log.current()


def rematch_changed(spark, sf):
    """Two runs over all parts: the second decides only what was retitled, drops what is listed no more, and keeps favorites and picks."""
    return _rematched(spark, sf, 2).select("module_id", "link", "confidence", "series_id", "format", "publication", "year", "run")


def rematch_build(spark, sf):
    """A third run against another build decides every title again; picks whose series went are gone."""
    return _rematched(spark, sf, 3).select("module_id", "link", "confidence", "series_id", "format", "publication", "year", "run")


def match_reports(spark, sf):
    """Examined and accepted matches per confidence, of the second run's table."""
    return resolve.match_report(_rematched(spark, sf, 2))


def match_cover_invalidation(spark, sf):
    """Covers that stay when new matches are stored."""
    p = table(spark, sf, "part")
    covers = p.select(F.col("p_brand").alias("module_id"), F.col("p_partkey").alias("link"), F.when(F.col("p_partkey") % 2 == 0, "match").otherwise("site").alias("source"), F.when(F.col("p_partkey") % 6 < 4, F.col("p_size").cast("long")).alias("series_id"))
    return catalog.invalidate(covers, catalog.accepted(matches(spark, sf))).select("link", "source", "series_id")


def match_module_ids(spark, sf):
    parts = listing(spark, sf)
    other = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("module_id"))
    return catalog.module_ids(parts, other, table(spark, sf, "orders").select(F.col("o_orderstatus").alias("module_id")), matches(spark, sf))


def host_modules(spark, sf):
    """Pages with the last of the suppliers' sites whose address holds their host."""
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace(host, r"^(m|blog)[.]", "www.").alias("host"))
    roots = table(spark, sf, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("module_id"), F.concat(F.lit("https://x."), F.regexp_replace(host, r"^(m|blog)[.]", ""), F.lit("/")).alias("root_url"))
    return library.modules_of_hosts(pages, "host", roots).select("page_id", "module_id")


def url_hosts(spark, sf):
    d = table(spark, sf, "pages").select("page_id", clean.url_parts(F.col("url")).alias("u"))
    return d.select("page_id", F.col("u.host").alias("host"), F.col("u.path").alias("path"))


def link_form_sets(spark, sf):
    root = F.concat(F.lit("https://"), F.lower("p_brand"), F.lit("/"))
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/t/"), "p_partkey")).otherwise(F.concat(F.lit("https://"), F.lower("p_brand"), F.lit("/t/"), "p_partkey"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(clean.link_forms(root, link), " ").alias("forms"))


def value_maps(spark, sf):
    kind = F.get(F.array(*[F.lit(x) for x in ("manga", "manhwa", "novel", "oel")]), (F.col("p_size") % 4).cast("int"))
    state = F.get(F.array(*[F.lit(x) for x in ("releasing", "completed", "upcoming")]), (F.col("p_size") % 3).cast("int"))
    code = (F.col("p_size") % 5).cast("string")
    return table(spark, sf, "part").select("p_partkey", clean.format_of(kind).alias("format"), clean.publication_of(state).alias("publication"), clean.status_name(code).alias("status"), clean.status_code(F.concat(F.lit("Series "), state, F.lit(" on hiatus")), "Releasing", "complete").alias("code"))


def entity_cleanup(spark, sf):
    raw = F.concat(F.lit(" &Eacute;t&eacute &amp; "), "p_name", F.lit(" &#8230;&nbsp;&copy;2\n"))
    return spread(table(spark, sf, "part")).select("p_partkey", clean.common_filter(raw).alias("clean"), clean.get_between(F.concat(F.lit("a("), "p_name", F.lit("(x)y)b")), "(", ")").alias("inner"), clean.separate_left(F.col("p_type"), "O").alias("lhs"), clean.separate_right(F.col("p_type"), "O").alias("rhs"), clean.trim_of(F.col("p_brand"), "Bd#1").alias("bare"))


def renamed_files(spark, sf):
    c = F.col("p_partkey")
    author = F.when(c % 3 != 0, F.col("p_brand"))
    chapter = F.concat(F.lit("Vol."), (c % 9).cast("string"), F.lit(" Ch."), (c % 50).cast("string"))
    name = names.custom_rename("%MANGA% [%AUTHOR%] %CHAPTER%", pad=(2, 3), manga=F.concat("p_name", F.lit("/x")), author=author, chapter=chapter)
    page = names.page_name("p_%FILENAME%", F.when(c % 2 == 0, F.col("p_type")), c)
    return spread(table(spark, sf, "part")).select("p_partkey", name.alias("name"), page.alias("page"), names.fitted(F.col("p_name"), 6).alias("short"))


def search_page_total(spark, sf):
    """The second page of a search with the total of its rows; a size over the most is cut down to it."""
    rows = listing(spark, sf).where(catalog.contains_ci("title", "ST", "alttitles"))
    return catalog.numbered_page(rows, 2, 1_000, "module_id", "link", "title")


def format_counts(spark, sf):
    rows = catalog.matched(listing(spark, sf), matches(spark, sf)).select(F.when(F.col("series_id").isNotNull(), F.col("format")).alias("format"))
    return library.format_facets(rows, ("3", "1", "0", "unknown"))


def site_counts(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("module_id"), F.concat(F.lit("site "), (F.lit(99) - F.col("c_nationkey")).cast("string")).alias("website"))
    return library.site_counts(rows, "module_id", "website")


def all_words_filter(spark, sf):
    return table(spark, sf, "part").where(clean.all_words(F.concat_ws(" ", "p_name", "p_type", "p_brand"), "Brand PROMO 1")).select("p_partkey")


def chapter_labels(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("C"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit("-"), F.col("l_partkey").cast("string")))).alias("names"))
    return d.select("l_orderkey", clean.chapter_label(F.col("names"), F.lit(2)).alias("label"))


def distinct_chapter_counts(spark, sf):
    d = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.upper("o_orderpriority"))).otherwise(F.lower("o_orderpriority")).alias("link"))
    return library.distinct_chapters(d, "o_custkey", "link")


def person_credits(spark, sf):
    """Suppliers of each order once, in any case of letters, with their lines' flags as roles in order."""
    d = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("s"), F.col("l_suppkey") % 3)).otherwise(F.concat(F.lit("S"), F.col("l_suppkey") % 3)).alias("person"), F.concat(F.col("l_returnflag"), F.col("l_linenumber")).alias("role"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey") * 10 + F.floor("l_quantity") % 10).alias("place"))
    lines = d.groupBy("l_orderkey", "place").agg(F.min("person").alias("person"), F.min("role").alias("role"))
    return library.credits(lines, "l_orderkey").select("l_orderkey", "person", "roles")


def appended_positions(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where("o_orderstatus = 'F'").select("o_custkey", (F.col("o_orderkey") % 11).cast("int").alias("place"))
    return ordered.appended(old, o.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "place").select("o_custkey", "o_orderkey", "place")


def queue_search(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("module_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("last_at"), F.lit("1995-06-01").cast("timestamp_ntz").alias("added_at"))
    chapters = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("Ch "), "l_partkey").alias("name"))
    found = queue.tasks_page(tasks, chapters, "h 11", F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    return found.select("task_id", "title")


def queue_retries(spark, sf):
    chapters = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("position"), (F.col("l_returnflag") == "R").alias("failed"))
    return queue.retries(chapters, table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 4).cast("int").alias("retried")), 2)


def queue_rate(spark, sf):
    return queue.total_rate(table(spark, sf, "orders").select((F.col("o_orderstatus") == "P").alias("active"), F.floor("o_totalprice").cast("double").alias("rate")))


def log_text_search(spark, sf):
    level = F.get(F.array(*[F.lit(x) for x in queue.LEVELS]), (F.col("event_id") % 5).cast("int"))
    lines = table(spark, sf, "events").select(F.col("event_id").alias("seq"), level.alias("level"), F.col("event_type").alias("target"), F.col("props").alias("message"), F.lit(None).cast("string").alias("module"))
    return queue.log_search(lines, "ERR", "INFO").unionByName(queue.log_search(lines, '"K": 7', "WARN")).select("seq", "level")


def log_merge(spark, sf):
    """Two overlapping parts of a log merged by number: what was kept stays, the newest 500 go on."""
    e = table(spark, sf, "events")
    kept = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("seq"), F.lit("kept").alias("origin"))
    return queue.merged_lines(kept, e.where("event_id % 2 = 0").select(F.col("event_id").alias("seq"), F.lit("more").alias("origin")), 500)


def stream_failures(spark, sf):
    """Failures in a row at each check of a stream, and until when failing keys rest."""
    failed = F.col("event_type").isin("error", "view")
    return stateful.run_to_end(streams.source(spark, sf), lambda s: stateful.failures(s, failed)).select("event_id", "key", "failures", "rests_until")


def _rematch_sql(runs):
    """The table after some runs, decided at once: each title as it is last listed, against the last build."""
    build = "p_size < 40" if runs < 3 else "p_size < 35"
    again = "3" if runs == 3 else "CASE WHEN title <> old THEN 2 ELSE 1 END"
    # a pick is stored by the first run, and again by a later one if its series has changed or is back
    return f"""WITH p AS (SELECT *, p_partkey n, p_name || ' ' || CASE WHEN p_size < 25 THEN p_partkey ELSE p_partkey % 2 END old FROM part),
    s AS (SELECT n id, old k, p_type, p_size FROM p WHERE {build}),
    i AS (SELECT n, p_brand, p_type, old, CASE WHEN n % 11 <> 0 AND n % 7 = 0 THEN p_name || ' 1' ELSE old END title FROM p WHERE n % 13 <> 0 AND (n % 11 <> 0 OR n % 22 = 0)),
    c AS (SELECT n, count(*) cand, count(*) FILTER (WHERE s.p_size >= 5) hits, count(*) FILTER (WHERE s.p_size >= 5 AND s.p_type = i.p_type) agree, min(id) FILTER (WHERE s.p_size >= 5 AND s.p_type = i.p_type) id FROM i JOIN s ON s.k = i.title GROUP BY 1),
    d AS (SELECT p_brand, n, {again} run, CASE WHEN cand > 50 THEN 'ambiguous' WHEN coalesce(hits, 0) = 0 THEN 'none' WHEN agree = 0 THEN 'author-conflict' WHEN agree = 1 THEN 'title+author' ELSE 'ambiguous' END confidence, id FROM i LEFT JOIN c USING (n)),
    m AS (SELECT p_brand, n, confidence, CASE WHEN confidence = 'title+author' THEN id END id, run FROM d UNION ALL SELECT p_brand, n, 'manual', n + 1, 1 FROM p WHERE n % 13 = 0)
    SELECT p_brand module_id, n link, confidence, id series_id, CASE WHEN p_size < 5 THEN 'other' WHEN p_size IS NOT NULL THEN 'manhwa' END AS format, CASE WHEN p_size % 2 = 0 THEN 'ongoing' END publication, (p_size + 1980)::INT AS year, run::BIGINT run
    FROM m LEFT JOIN s USING (id) WHERE confidence <> 'manual' OR p_size IS NOT NULL"""


Q, S = {}, {}
for _f, _sql in (
    (
        resolve_tiers,
        """WITH p AS (SELECT *, p_partkey n, lower(p_name) || ' ' || p_partkey % 7 k FROM part), s AS (SELECT * FROM p WHERE p_size < 30),
        lk AS (SELECT DISTINCT n AS series, unnest([n, (n + 4) * (n % 2)]) k FROM p),
        l AS (SELECT i.n link, min(series) id FROM p i JOIN lk ON lk.k = i.n WHERE i.n % 4 = 0 GROUP BY 1 HAVING count(DISTINCT series) = 1),
        xk AS (SELECT DISTINCT l_partkey k, l_partkey + l_suppkey % 2 * (l_partkey % 2) AS series FROM lineitem),
        x AS (SELECT i.n link, min(series) id FROM p i JOIN xk ON xk.k = i.n WHERE i.n % 3 = 0 GROUP BY 1 HAVING count(DISTINCT series) = 1),
        told AS (SELECT link, 'link' confidence, id FROM l JOIN s ON s.n = id UNION ALL SELECT link, 'cross-id', id FROM x JOIN s ON s.n = id WHERE link NOT IN (SELECT link FROM l JOIN s ON s.n = id)),
        r AS (SELECT * FROM p WHERE n NOT IN (SELECT link FROM told)),
        c AS (SELECT r.n link, count(*) n, count(*) FILTER (WHERE s.p_type = r.p_type) agree, min(s.n) FILTER (WHERE s.p_type = r.p_type) id FROM r JOIN s USING (k) GROUP BY 1),
        t AS (SELECT r.n link, CASE WHEN c.n > 25 THEN 'ambiguous' WHEN coalesce(c.n, 0) = 0 THEN 'none' WHEN agree = 0 THEN 'author-conflict' WHEN agree = 1 THEN 'title+author' ELSE 'ambiguous' END confidence, id FROM r LEFT JOIN c ON link = r.n)
        SELECT link, confidence, id series_id FROM told UNION ALL SELECT link, confidence, CASE WHEN confidence = 'title+author' THEN id END FROM t""",
    ),
    (rematch_changed, _rematch_sql(2)),
    (rematch_build, _rematch_sql(3)),
    (match_reports, f"SELECT unnest([confidence, 'all']) AS confidence, count(*) examined, count(*) FILTER (WHERE series_id IS NOT NULL) accepted FROM ({_rematch_sql(2)}) GROUP BY 1"),
    (match_cover_invalidation, f"SELECT p_partkey link, CASE WHEN p_partkey % 2 = 0 THEN 'match' ELSE 'site' END source, CASE WHEN p_partkey % 6 < 4 THEN p_size END::BIGINT series_id FROM part LEFT JOIN (SELECT link, series_id new, true stored FROM {MATCHES_SQL}) ON link = p_partkey WHERE stored IS NULL OR NOT ((p_partkey % 2 = 0 AND CASE WHEN p_partkey % 6 < 4 THEN p_size END IS DISTINCT FROM new) OR (p_partkey % 2 = 1 AND new IS NOT NULL))"),
    (match_module_ids, "SELECT p_brand module_id FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT o_orderstatus FROM orders"),
    (
        host_modules,
        r"""WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/:]+)', 1), '^(m|blog)[.]', 'www.') host, 'https://x.' || regexp_replace(regexp_extract(url, '^https?://([^/:]+)', 1), '^(m|blog)[.]', '') || '/' root FROM pages)
        SELECT a.page_id, coalesce(max(b.page_id) FILTER (WHERE contains(b.root, lower(a.host))), max(b.page_id) FILTER (WHERE contains(lower(a.host), 'w') AND length(a.host) > 4 AND contains(b.root, lower(a.host)[5:]))) module_id FROM h a JOIN h b ON b.page_id % 3 = 0 GROUP BY 1""",
    ),
    (url_hosts, "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS host, regexp_replace(url, '^[a-z]+://[^/]+', '') AS path FROM pages"),
    (link_form_sets, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/t/' || p_partkey || ' https://' || lower(p_brand) || '/t/' || p_partkey ELSE 'https://' || lower(p_brand) || '/t/' || p_partkey || ' /t/' || p_partkey END forms FROM part"),
    (value_maps, "SELECT p_partkey, ['manga', 'manhwa', 'other', 'oel'][p_size % 4 + 1] AS format, ['ongoing', 'completed', NULL][p_size % 3 + 1] AS publication, ['completed', 'ongoing', 'hiatus', 'cancelled', 'unknown'][p_size % 5 + 1] AS status, ['1', '0', '2'][p_size % 3 + 1] AS code FROM part"),
    (entity_cleanup, "SELECT p_partkey, 'Été & ' || p_name || ' ... €2' AS clean, p_name || '(x)y' AS inner, CASE WHEN contains(p_type, 'O') THEN split_part(p_type, 'O', 1) ELSE p_type END lhs, CASE WHEN contains(p_type, 'O') THEN substr(p_type, instr(p_type, 'O') + 1) ELSE p_type END rhs, trim(p_brand, 'Bd#1') bare FROM part"),
    (renamed_files, "SELECT p_partkey, p_name || '_x ' || CASE WHEN p_partkey % 3 <> 0 THEN '[' || p_brand || ']' ELSE '' END || ' Vol.0' || p_partkey % 9 || ' Ch.0' || lpad((p_partkey % 50)::VARCHAR, 2, '0') AS name, 'p_' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lpad((p_partkey + 1)::VARCHAR, greatest(3, length((p_partkey + 1)::VARCHAR))::INT, '0') END AS page, right(p_name, 6) AS short FROM part"),
    (search_page_total, "WITH r AS (SELECT * FROM part WHERE contains(lower(p_name), 'st') OR contains(lower(p_type), 'st')) SELECT p_brand module_id, p_partkey link, p_name title, (SELECT count(*) FROM r) total FROM r ORDER BY lower(p_name), p_brand, p_partkey LIMIT 200 OFFSET 200"),
    (format_counts, f"SELECT coalesce(CASE WHEN series_id IS NOT NULL THEN format END, 'unknown') AS format, count(*) n, (CASE any_value(coalesce(CASE WHEN series_id IS NOT NULL THEN format END, 'unknown')) WHEN '3' THEN 1 WHEN '1' THEN 2 WHEN '0' THEN 3 WHEN 'unknown' THEN 4 ELSE 5 END)::INT AS place FROM {LISTING_SQL} l LEFT JOIN {MATCHES_SQL} m USING (module_id, link) GROUP BY 1"),
    (site_counts, "SELECT c_nationkey module_id, 'site ' || (99 - c_nationkey) website, count(*) n FROM customer GROUP BY 1"),
    (all_words_filter, "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'promo') AND contains(p_name || ' ' || p_type || ' ' || p_brand, '1') AND contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'brand')"),
    (chapter_labels, "SELECT l_orderkey, a[least(3, len(a))] || CASE WHEN len(a) > 1 THEN ' (' || least(3, len(a)) || '/' || len(a) || ')' ELSE '' END AS label FROM (SELECT l_orderkey, list_sort(list('C' || lpad(l_linenumber::VARCHAR, 3, '0') || '-' || l_partkey)) a FROM lineitem GROUP BY 1)"),
    (distinct_chapter_counts, "SELECT o_custkey, count(DISTINCT lower(o_orderpriority)) n_chapters FROM orders GROUP BY 1"),
    (
        person_credits,
        """WITH d AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey * 10 + floor(l_quantity)::BIGINT % 10 place, min(CASE WHEN l_linenumber % 2 = 0 THEN 's' ELSE 'S' END || l_suppkey % 3) person, min(l_returnflag || l_linenumber) AS role FROM lineitem GROUP BY ALL),
        r AS (SELECT l_orderkey, lower(person) p, role, min(place) place FROM d GROUP BY ALL),
        n AS (SELECT l_orderkey, lower(person) p, arg_min(person, place) person FROM d GROUP BY 1, 2)
        SELECT l_orderkey, person, string_agg(role, ', ' ORDER BY place) roles FROM r JOIN n USING (l_orderkey, p) GROUP BY ALL""",
    ),
    (appended_positions, "WITH t AS (SELECT o_custkey, max(o_orderkey % 11) + 1 AS nxt FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o.o_custkey, o_orderkey, (coalesce(nxt, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey) - 1)::INT place FROM orders o LEFT JOIN t USING (o_custkey) WHERE o_orderstatus = 'P'"),
    (queue_search, "SELECT o_orderkey task_id, o_orderpriority title FROM orders WHERE coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, TIMESTAMP '1995-06-01') BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND (contains(lower(o_orderpriority), 'h 11') OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE contains(lower('Ch ' || l_partkey), 'h 11')))"),
    (queue_retries, "SELECT l_orderkey task_id, min(l_linenumber) chapter, (o_orderkey % 4 + 1)::INT retried FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderkey % 4 < 2 GROUP BY l_orderkey, o_orderkey"),
    (queue_rate, "SELECT coalesce(sum(floor(o_totalprice)) FILTER (WHERE o_orderstatus = 'P'), 0) rate FROM orders"),
    (log_text_search, "WITH n AS (SELECT event_id seq, ['ERROR','WARN','INFO','DEBUG','TRACE'][event_id % 5 + 1] AS level, event_type, props FROM events) SELECT seq, level FROM n WHERE level IN ('ERROR', 'WARN', 'INFO') AND (contains(event_type, 'err') OR contains(lower(props), 'err')) UNION ALL SELECT seq, level FROM n WHERE level IN ('ERROR', 'WARN') AND contains(props, '\"k\": 7')"),
    (log_merge, "SELECT event_id seq, CASE WHEN event_id % 3 <> 0 THEN 'kept' ELSE 'more' END origin FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0 ORDER BY 1 DESC LIMIT 500"),
    (
        stream_failures,
        """WITH e AS (SELECT event_id, user_id AS key, epoch_us(ts) // 1000 ms, event_type IN ('error', 'view') f, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) i FROM events),
        g AS (SELECT *, coalesce(max(CASE WHEN NOT f THEN i END) OVER (PARTITION BY key ORDER BY i), 0) k FROM e)
        SELECT event_id, key, i - k AS failures, CASE WHEN i - k >= 3 THEN ms + 86400000 END rests_until FROM g""",
    ),
):
    Q[_f.__name__], S[_f.__name__] = _f, _sql
