"""The directory of pages, the registry, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid.functions import places
from noticegrid.operators import directory as D
from noticegrid.operators import feed
from noticegrid.operators.common import delete_matching, insert_missing, upsert
from noticegrid.session import checkpoint_root
from noticegrid.sources import readers, sinks
from noticegrid.workload import views as V
from noticegrid.workload.registry import register



def today():
    return F.lit("2026-08-01").cast("date")


_KEY = "lower(city) || '|' || state"


def fresh(v, name: str) -> str:
    """A new folder of its own for one run."""
    import uuid
    return f"{checkpoint_root(v.spark)}/{name}-{uuid.uuid4().hex}"


@register("s1_read_portal_csv", V.sql("crawl", f"SELECT {_KEY} AS city_key, bid_url AS url, CASE WHEN platform = '' THEN 'custom' ELSE platform END AS platform FROM crawl WHERE status = 'found'"))
def _(v):
    path = fresh(v, "portals")
    sinks.write_csv(v.crawl().select("domain", "city", "state", "type", F.lit("o").alias("org"), "status", "bid_url", "platform", F.lit("2026-01-01").alias("checked_date")), path)
    return readers.read_portal_csv(v.spark, path).select("city_key", "url", "platform")


_GAZ = "SELECT city, state, lat, lon FROM towns WHERE town_id % 10 <> 3"


@register("s2_read_gazetteer", V.sql("towns", f"SELECT city, state, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({_GAZ})"))
def _(v):
    k = F.col("town_id")
    rows = v.towns().select("city", F.lower("state").alias("state"), F.when(k % 10 == 3, F.lit("n/a")).otherwise(F.col("lat").cast("string")).alias("lat"),
                            F.col("lon").cast("string").alias("lon"), F.lit(0).alias("ord"))
    again = rows.withColumns({"city": F.upper("city"), "lat": F.when(F.col("lat") == "n/a", F.col("lat")).otherwise(F.lit("1.0")), "ord": F.lit(1)})
    path = fresh(v, "towns")
    rows.unionByName(again).write.option("header", True).csv(path)
    out = readers.read_gazetteer(v.spark, path, order="ord")
    return out.select("city", "state", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@register("s3_read_gov_domains", V.sql("registry", "SELECT domain, type, org, city, state FROM registry"))
def _(v):
    path = fresh(v, "registry")
    sinks.write_csv(v.registry().select(F.concat(F.lit(" "), F.upper("domain")).alias("domain"), "type", "org", "city", F.lower("state").alias("state")), path)
    return readers.read_gov_domains(v.spark, path)


@register("s4_refresh_registry", V.sql("registry", "SELECT domain, type, org, city, state FROM registry WHERE length(domain) % 7 <> 0"))
def _(v):
    raw = v.registry().select(F.when(F.length("domain") % 7 == 0, F.lit("Federal - Executive")).otherwise(F.col("type")).alias("domain_type"),
                              F.upper("domain").alias("domain_name"), F.col("org").alias("organization_name"), "city", "state")
    path = fresh(v, "refreshed")
    sinks.refresh_registry(raw, path, min_rows=1)
    return readers.read_gov_domains(v.spark, path)


@register("s5_read_permits", "SELECT 'P' || o_orderkey AS permit_id, strftime(o_orderdate, '%Y-%m-%d') AS issued_date FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate >= DATE '2001-07-20' - INTERVAL 45 DAY")
def _(v):
    path = fresh(v, "permits")
    k = F.col("o_orderkey")
    v.table("orders").select(
        F.concat(F.lit("P"), k.cast("string")).alias("permit_number"), F.lit("1 Main").alias("permit_location"),
        F.when(k % 2 == 0, F.lit("Driveway / Sidewalks")).otherwise(F.lit("Plumbing")).alias("permit_type_desc"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00.000").alias("issue_date"), F.lit("30.1").alias("latitude"), F.lit("-97.7").alias("longitude")).write.json(path)
    as_of = F.lit("2001-07-20").cast("timestamp")
    return readers.read_permits(v.spark, path, "austin", as_of).select("permit_id", "issued_date")


@register("s6_read_federal", V.sql("bids", "SELECT bid_id, town_state AS perf_state FROM bids WHERE order_day BETWEEN DATE '2000-06-01' AND DATE '2000-07-01' AND town_state IN ('TX', 'MO', 'OK')"))
def _(v):
    path = fresh(v, "federal")
    v.bids().join(v.table("orders").select(F.col("o_orderkey").alias("bid_id"), "o_orderdate"), "bid_id").select(
        "title", F.col("bid_id").cast("string").alias("noticeId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("postedDate"),
        F.struct(F.struct(F.col("town").alias("name")).alias("city"), F.struct(F.col("town_state").alias("code")).alias("state")).alias("placeOfPerformance")).write.json(path)
    got = readers.read_federal(v.spark, path, ["TX", "MO", "OK"], F.lit("2000-07-01").cast("timestamp"), window_days=30)
    return got.select(F.col("noticeId").cast("bigint").alias("bid_id"), "perf_state")


@register("s7_read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(v):
    return readers.read_pages(v.spark, f"{v.folder}/pages.parquet", ["page_id", "url", "html"]).select("page_id", "url", F.length("html").alias("chars"))


_SAVED = "SELECT bid_id, town, title, scope, value, deadline, contact, email, phone, url, CASE bid_id % 6 WHEN 0 THEN 'submitted' WHEN 1 THEN 'won' WHEN 2 THEN 'lost' WHEN 3 THEN 'passed' ELSE '' END AS pipeline FROM bids"


def saved(v):
    k = F.col("bid_id") % 6
    return v.bids().drop("city").withColumnRenamed("town", "city").withColumn("pipeline", V.pick(["submitted", "won", "lost", "passed", "", ""], k))


@register("s11_export_bids_csv", V.sql("bids", """SELECT town AS "City", title AS "Title", status AS "Status", scope AS "Scope", value AS "Est. Value", deadline AS "Deadline", contact AS "Contact", email AS "Email", phone AS "Phone", url AS "Link" FROM bids"""))
def _(v):
    path = fresh(v, "bids")
    sinks.export_bids_csv(v.bids().drop("city").withColumnRenamed("town", "city"), path)
    back = v.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in back.columns])


@register("s12_export_saved_csv", V.sql("bids", """SELECT town AS "City", title AS "Title", scope AS "Scope", value AS "Est. Value", deadline AS "Deadline", contact AS "Contact", email AS "Email", phone AS "Phone", url AS "Source URL", pipeline AS "Pipeline Status" FROM sv WHERE pipeline = 'won'""", sv=_SAVED))
def _(v):
    path = fresh(v, "saved")
    sinks.export_saved_csv(saved(v), path, "won")
    back = v.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in back.columns])


@register("f17_pipeline_filter", V.sql("bids", "SELECT bid_id FROM sv WHERE pipeline = ''", sv=_SAVED))
def _(v):
    return feed.pipeline_filter(saved(v), "none").select("bid_id")


@register("s13_export_leads_csv", V.sql("leads", """SELECT city AS "City", address AS "Address", permit_type AS "Permit Type", description AS "Description", issued_date AS "Issued Date", contractor_name AS "Builder/Contact",
    contractor_trade AS "Trade", '' AS "Phone", '' AS "Permit Record", outreach AS "Status" FROM leads"""))
def _(v):
    path = fresh(v, "leads")
    sinks.export_leads_csv(v.leads(), path)
    back = v.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in back.columns if c != "Lead Type"])


@register("s14_export_tables", V.sql("bids leads", "SELECT 'saved_bids' AS \"table\", count(*) AS rows, '' AS error FROM bids UNION ALL SELECT 'leads', count(*), '' FROM leads UNION ALL SELECT 'events', count(*), '' FROM events"))
def _(v):
    return sinks.export_tables({"saved_bids": saved(v), "leads": v.leads(), "events": v.table("events")}, fresh(v, "dump"))


@register("s15_map_points", V.sql("searches gazetteer", f"""SELECT search_id, label, color FROM (SELECT search_id, 'Search center: ' || city AS label, '#f5b400' AS color FROM searches
    UNION ALL SELECT s.search_id, t.city || ', ' || t.state || CASE WHEN length(t.city) % 4 = 0 THEN ' — no bid page auto-found' WHEN s.search_id % 2 = 0 THEN ' — 3 bid(s) found' ELSE ' — scanned, no open bids' END,
      CASE WHEN length(t.city) % 4 = 0 THEN '#9aa0a6' WHEN s.search_id % 2 = 0 THEN '#34a853' ELSE '#4a90e2' END FROM searches s JOIN gazetteer t ON {V.sql_distance('s.lat', 's.lon', 't.lat', 't.lon')} <= s.radius)"""))
def _(v):
    from noticegrid.operators.radius import within_radius
    s = v.searches()
    near = within_radius(s.select("search_id", "lat", "lon", "radius"), v.gazetteer(), by=["search_id", "city"]).select(
        "search_id", F.col("city").alias("name"), "state", "lat", "lon", F.when(F.length("city") % 4 == 0, F.lit("skipped")).otherwise(F.lit("scanned")).alias("status"))
    counts = near.where("search_id % 2 = 0").select("search_id", "name", F.lit(3).alias("n_bids")).distinct()
    return feed.map_points(s.select("search_id", "lat", "lon", F.col("city").alias("label")), near, counts).select("search_id", "label", "color")


@register("s16_resume_work", V.sql("crawl", "SELECT domain FROM crawl WHERE status <> 'found'"))
def _(v):
    return sinks.resume_work(v.crawl().select("domain"), v.crawl().where("status = 'found'"), ["domain"])


@register("s17_append_or_rewrite", V.sql("crawl", "SELECT domain, CASE WHEN row_ord % 4 = 1 AND status <> 'found' THEN 'found' ELSE status END AS status FROM crawl"))
def _(v):
    """The files that a run, a resumed run and a recheck of the misses leave."""
    c, path = v.crawl().select("domain", "status", "row_ord"), fresh(v, "snapshot")
    first = c.where("row_ord % 5 < 2")
    sinks.append_rows(first, path, ["domain"], 8)
    sinks.append_rows(c.join(sinks.resume_work(c.select("domain"), sinks.read_snapshot(v.spark, path), ["domain"]), "domain"), path, ["domain"], 8)
    again = c.where("row_ord % 4 in (1, 0)").withColumn("status", F.when(F.col("row_ord") % 4 == 1, F.lit("found")).otherwise(F.lit("not_found")))
    sinks.rewrite_rows(D.newly_found(sinks.read_snapshot(v.spark, path), again), path, ["domain"], 8)
    return sinks.read_snapshot(v.spark, path).select("domain", "status")


# ---- directory ----------------------------------------------------------------------
@register("j3_seed_directory", V.sql("portals", """SELECT city_key, url, source, fail_count FROM (SELECT *, min(tier) OVER (PARTITION BY city_key) AS best FROM (
    SELECT city_key, url, 3 AS tier, 'wikidata' AS source, 0 AS fail_count FROM portals UNION ALL SELECT city_key, url || '?n', 2, 'national_crawl', 0 FROM portals WHERE length(city_key) % 2 = 0
    UNION ALL SELECT city_key, url || '?h', 1, 'seed', 0 FROM portals WHERE fail_count % 3 = 1 UNION ALL SELECT city_key, url || '?s', 0, source, fail_count FROM portals WHERE fail_count = 2)) WHERE tier = best"""))
def _(v):
    p = v.portals()
    tier = lambda cond, n, tail: p.where(cond).withColumns({"tier": F.lit(n), "url": F.concat("url", F.lit(tail))})
    tiers = p.withColumn("tier", F.lit(3)).unionByName(tier("length(city_key) % 2 = 0", 2, "?n")).unionByName(
        tier("fail_count % 3 = 1", 1, "?h")).unionByName(tier("fail_count = 2", 0, "?s"))
    return D.seed_directory(tiers, today()).select("city_key", "url", "source", "fail_count")


@register("j4_learn_portals", V.sql("portals crawl", f"""SELECT city_key, url, 'learned' AS source FROM (SELECT DISTINCT {_KEY} AS city_key, CASE WHEN row_ord % 5 = 4 THEN 'https://sam.gov/' || row_ord ELSE bid_url END AS url FROM crawl WHERE bid_url <> '')
    WHERE url NOT LIKE 'https://sam.gov%' AND (city_key, url) NOT IN (SELECT (city_key, url) FROM portals WHERE fail_count > 1)"""))
def _(v):
    found = v.crawl().where("bid_url <> ''").select(places.place_key("city", "state").alias("city_key"),
                                                    F.when(F.col("row_ord") % 5 == 4, F.concat(F.lit("https://sam.gov/"), F.col("row_ord").cast("string"))).otherwise(F.col("bid_url")).alias("url"),
                                                    F.col("row_ord").alias("seq"))
    twice = found.unionByName(found.withColumn("seq", F.col("seq") + 1))
    return D.learn_portals(v.portals().where("fail_count > 1"), twice, today()).select("city_key", "url", "source")




@register("j5_record_results", V.sql("portals fetch_log", """SELECT p.url, CASE WHEN r.n IS NULL THEN p.fail_count WHEN r.ok_at IS NULL THEN p.fail_count + r.n ELSE (SELECT count(*) FROM fetch_log f WHERE 'https://h' || f.portal || '.gov' = p.url AND NOT f.ok AND (f.ts, f.seq) > (r.ok_at, r.ok_seq)) END AS fail_count, CAST(r.ok_at AS DATE) AS last_ok, CAST(r.at AS DATE) AS last_checked
    FROM (SELECT DISTINCT 'https://h' || portal || '.gov' AS url, CAST(portal % 4 AS INTEGER) AS fail_count FROM fetch_log UNION ALL SELECT 'https://quiet.gov', 2) p LEFT JOIN (SELECT 'https://h' || portal || '.gov' AS url, count(*) AS n, max(ts) FILTER (WHERE ok) AS ok_at, arg_max(seq, ts) FILTER (WHERE ok) AS ok_seq, max(ts) AS at FROM fetch_log GROUP BY portal) r ON r.url = p.url"""))
def _(v):
    log = v.fetch_log().select(F.lit("k").alias("city_key"), F.concat(F.lit("https://h"), F.col("portal").cast("string"), F.lit(".gov")).alias("url"), "ts", "seq", "ok", "portal")
    known = log.select("city_key", "url", (F.col("portal") % 4).cast("int").alias("fail_count")).distinct().unionByName(
        v.spark.range(1).select(F.lit("k").alias("city_key"), F.lit("https://quiet.gov").alias("url"), F.lit(2).alias("fail_count")))
    stored = known.withColumns({"last_ok": F.lit(None).cast("date"), "last_checked": F.lit(None).cast("date")})
    return D.record_results(stored, log.drop("portal")).select("url", "fail_count", "last_ok", "last_checked")


@register("j10_known_domains", V.sql("registry towns", """SELECT city_key, domain, CAST(row_number() OVER (PARTITION BY city_key ORDER BY t, named, domain) AS INTEGER) AS rank FROM (
    SELECT lower(r.city) || '|' || r.state AS city_key, r.domain, CASE type WHEN 'City' THEN 0 WHEN 'County' THEN 1 WHEN 'Special district' THEN 2 ELSE 3 END AS t, CASE WHEN contains(replace(lower(org), ' ', '') || replace(domain, '.', ''), lower(r.city)) THEN 0 ELSE 1 END AS named
    FROM (SELECT domain, type, org, city, state FROM registry UNION ALL SELECT 'x' || domain, 'City', 'City of Elsewhere', city, state FROM registry) r SEMI JOIN towns t ON t.city = r.city AND t.state = r.state)"""))
def _(v):
    reg = v.registry()
    more = reg.withColumns({"domain": F.concat(F.lit("x"), "domain"), "type": F.lit("City"), "org": F.lit("City of Elsewhere")})
    return D.known_domains(v.towns(), reg.unionByName(more)).select("city_key", "domain", "rank")


@register("j11_known_in_state", V.sql("registry towns", """SELECT DISTINCT city, state FROM towns t WHERE EXISTS (SELECT 1 FROM registry r WHERE lower(r.city) = lower(t.city) AND r.state = t.state)
    OR (length(t.city) >= 8 AND EXISTS (SELECT 1 FROM registry r WHERE r.state = t.state AND contains(regexp_replace(lower(org), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(domain, '[^a-z0-9]', '', 'g'), lower(t.city))))"""))
def _(v):
    return D.known_in_state(v.towns(), v.registry())


@register("j12_town_for_url", V.sql("crawl portals", "SELECT p.url, c.city FROM portals p JOIN crawl c ON regexp_extract(p.url, '//([^/]+)', 1) = regexp_replace(c.domain, '^www\\.', '')"))
def _(v):
    return D.town_for_url(v.portals().select("url"), D.domain_index(v.crawl())).where("city is not null").select("url", "city")


@register("j13_coords_for_town", V.sql("towns gazetteer", "SELECT t.town_id, round(g.lat, 6) AS lat FROM towns t LEFT JOIN gazetteer g ON lower(g.city) = lower(t.city) AND g.state = t.state"))
def _(v):
    asked = v.towns().select("town_id", F.upper("city").alias("city"), F.lower("state").alias("state"))
    return D.coords_for_town(asked, v.gazetteer()).select("town_id", F.round("lat", 6).alias("lat"))


@register("j27_candidate_domains", V.sql("towns", "SELECT min(state) AS state, domain FROM (SELECT state, lower(city) || '.us' AS domain FROM towns WHERE town_id % 3 <> 0 AND town_id % 11 <> 0 UNION ALL SELECT 'AA', lower(city) || '.us' FROM towns WHERE town_id % 6 = 1 AND town_id % 11 <> 0) GROUP BY domain"))
def _(v):
    t = v.towns()
    site = F.concat(F.lit("http://www."), F.lower("city"), F.when(F.col("town_id") % 11 == 0, F.lit(".facebook.com/x")).otherwise(F.lit(".us/home")))
    rows = t.select("state", F.col("city").alias("place"), site.alias("website"), "town_id")
    more = rows.where("town_id % 6 = 1").withColumn("state", F.lit("AA"))
    known = t.where("town_id % 3 = 0").select(F.concat(F.lit("WWW."), "city", F.lit(".us")).alias("domain"))
    return D.candidate_domains(rows.unionByName(more), known).select("state", "domain")


@register("j29_append_prospects", V.sql("bids", "SELECT company, state FROM (SELECT DISTINCT contact || ' ' || town AS company, town_state AS state FROM bids) WHERE (company, state) NOT IN (SELECT (contact || ' ' || town, town_state) FROM bids WHERE bid_id % 2 = 0)"))
def _(v):
    rows = v.bids().select(F.concat_ws(" ", "contact", "town").alias("company"), F.col("town_state").alias("state"), "seq", "bid_id")
    return insert_missing(rows.where("bid_id % 2 = 0"), rows, ["company", "state"], [F.col("seq")]).select("company", "state")


@register("j29_next_states", V.sql("bids", "SELECT town_state AS state FROM (SELECT DISTINCT town_state FROM bids) WHERE town_state NOT IN (SELECT town_state FROM bids WHERE bid_id % 40 = 0 AND town_state > 'M') ORDER BY town_state LIMIT 8"))
def _(v):
    states = v.bids().select(F.col("town_state").alias("state")).distinct().withColumn("ord", F.col("state"))
    covered = v.bids().where("bid_id % 40 = 0 and town_state > 'M'").select(F.col("town_state").alias("state"))
    return D.next_states(states, covered).select("state")


@register("a6_directory_stats", V.sql("portals gazetteer", "SELECT 'portals:' || source AS metric, count(*) AS n FROM portals GROUP BY source UNION ALL SELECT 'geocoded_towns', count(*) FROM gazetteer"))
def _(v):
    return D.directory_stats(v.portals(), v.gazetteer())


@register("a15_found_rate", V.sql("crawl", "SELECT state, type, count(*) FILTER (WHERE status = 'found') AS found, count(*) AS probed, CAST(round(CAST(count(*) FILTER (WHERE status = 'found') * 100 AS DECIMAL(20,4)) / count(*), 2) AS DOUBLE) AS rate_pct FROM crawl GROUP BY state, type"))
def _(v):
    return D.found_rate(v.crawl(), "state", "type")


@register("a20_distinct_towns", V.sql("towns crawl", "SELECT city, state FROM crawl WHERE status = 'found' UNION ALL SELECT upper(city), state FROM towns WHERE town_id % 3 <> 0"))
def _(v):
    lists = v.crawl().where("status = 'found'").select("city", "state", F.lit(0).alias("list_ord"), "row_ord").unionByName(
        v.towns().select(F.upper("city").alias("city"), F.lower("state").alias("state"), F.lit(1).alias("list_ord"), F.col("town_id").alias("row_ord")))
    return D.distinct_towns(lists)


@register("a21_promote_portals", V.sql("crawl", "SELECT regexp_replace(domain, '^www\\.', '') AS domain, city, 'wikidata' AS source, CASE WHEN row_ord % 2 = 0 THEN '2025-01-01' ELSE '2026-08-01' END AS checked_date, 'civicplus' AS platform FROM crawl WHERE status = 'found'"))
def _(v):
    c = v.crawl().withColumn("domain", F.regexp_replace("domain", r"^www\.", ""))
    verified = c.select("domain", "state", F.concat_ws(", ", "city", "state").alias("place"), "bid_url", F.lit("domain").alias("owns"), "status", "row_ord")
    prior = c.where("row_ord % 2 = 0").select("domain", F.lit("2025-01-01").alias("checked_date"))
    twice = verified.unionByName(verified.withColumns({"place": F.lit("Other"), "row_ord": F.col("row_ord") + 1_000_000}))
    return D.promote_portals(twice, prior, F.lit("2026-08-01")).select("domain", "city", "source", "checked_date", "platform")


@register("w17_registry_order", V.sql("registry", "SELECT domain, type, row_number() OVER (ORDER BY CASE type WHEN 'City' THEN 0 WHEN 'County' THEN 1 WHEN 'Special district' THEN 2 ELSE 3 END, domain) AS place FROM registry"))
def _(v):
    return D.registry_order(v.registry()).select("domain", "type", "place")


@register("j23_upsert", V.sql("bids", "SELECT bid_id, CASE WHEN bid_id % 3 = 0 THEN 'new' ELSE title END AS title FROM bids"))
def _(v):
    b = v.bids().select("bid_id", "title")
    return upsert(b, b.where("bid_id % 3 = 0").withColumn("title", F.lit("new")), ["bid_id"])


@register("j24_delete_matching", V.sql("bids", "SELECT bid_id FROM bids WHERE status <> 'Closed'"))
def _(v):
    b = v.bids().select("bid_id", "status")
    return delete_matching(b, b.where("status = 'Closed'"), ["status"]).select("bid_id")


@register("u3_except", V.sql("bids", "SELECT town, title FROM bids EXCEPT ALL SELECT town, title FROM bids WHERE bid_id % 5 = 0"))
def _(v):
    b = v.bids()
    return b.select("town", "title").exceptAll(b.where("bid_id % 5 = 0").select("town", "title"))


@register("s14_table_counts", V.sql("bids", "SELECT 'bids' AS \"table\", count(*) AS rows FROM bids UNION ALL SELECT 'pages', count(*) FROM pages"))
def _(v):
    return sinks.table_counts({"bids": v.bids(), "pages": v.table("pages")})


