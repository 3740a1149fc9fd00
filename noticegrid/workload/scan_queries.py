"""Placing, radius and scan queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noticegrid.functions import geo, keys, places
from noticegrid.operators import bids as bid_ops
from noticegrid.operators import placing, radius
from noticegrid.operators.common import tally
from noticegrid.plans import alerts, scan
from noticegrid.session import run_folder
from noticegrid.session import stage as base_stage
from noticegrid.workload import views as V
from noticegrid.workload.registry import register
from noticegrid.workload.rule_queries import RELEVANT_TITLE

_DIST = V.sql_distance("s.lat", "s.lon", "t.lat", "t.lon")
_NEAR = f"SELECT s.search_id, s.state AS centre_state, s.radius, t.city, t.state, {_DIST} AS d FROM searches s, gazetteer t WHERE {_DIST} <= s.radius"
_TRUSTED = "SELECT DISTINCT city_key FROM portals WHERE fail_count < 5"
_REACH = f"SELECT n.* FROM ({_NEAR}) n WHERE lower(city) || '|' || state IN (SELECT city_key FROM trusted)"


@register("j1_within_radius", V.sql("gazetteer searches", f"SELECT search_id, city, state, round(d, 6) AS distance_mi FROM ({_NEAR})"))
def _(v):
    near = radius.within_radius(v.searches().select("search_id", "lat", "lon", "radius"), v.gazetteer())
    return near.select("search_id", "city", "state", F.round("distance_mi", 6).alias("distance_mi"))


@register("c7_haversine", V.sql("towns searches", f"SELECT s.search_id, t.city, l_orderkey AS hit, round({_DIST}, 6) AS distance_mi FROM lineitem JOIN searches s ON s.search_id = l_suppkey JOIN towns t ON t.town_id = l_partkey"))
def _(v):
    s = v.searches().select("search_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    hits = v.table("lineitem").select(F.col("l_suppkey").alias("search_id"), F.col("l_partkey").alias("town_id"), F.col("l_orderkey").alias("hit"))
    return hits.join(s, "search_id").join(v.towns(), "town_id").select("search_id", "city", "hit", F.round(geo.haversine_mi("slat", "slon", "lat", "lon"), 6).alias("distance_mi"))


@register("j2_towns_in_reach", V.sql("gazetteer searches portals", "SELECT search_id, city, state, round(d, 6) AS distance_mi FROM near "
          "WHERE NOT EXISTS (SELECT 1 FROM searches s WHERE s.search_id = near.search_id AND s.city = near.city)", trusted=_TRUSTED, near=_REACH))
def _(v):
    s = v.searches()
    own = s.select("search_id", places.place_key("city", "state").alias("city_key")).unionByName(
        # the town the search is centred on, in whatever state the gazetteer has it
        s.select("search_id", "city").join(v.gazetteer().select("city", "state"), "city").select(
            "search_id", places.place_key("city", "state").alias("city_key")))
    near = radius.towns_in_reach(s.select("search_id", "lat", "lon", "radius"), v.gazetteer(), v.portals(), own)
    return near.select("search_id", "city", "state", F.round("distance_mi", 6).alias("distance_mi"))


@register("w3_nearest_towns", V.sql("gazetteer searches", "SELECT search_id, city, state, rank FROM (SELECT *, row_number() OVER "
          "(PARTITION BY search_id ORDER BY round(d, 6), city, state) AS rank FROM near) WHERE rank <= 6", near=_NEAR))
def _(v):
    near = radius.within_radius(v.searches().select("search_id", "lat", "lon", "radius"), v.gazetteer())
    return radius.nearest_k(near, 6).select("search_id", "city", "state", "rank")


@register("w3_nearest_all", V.sql("gazetteer searches", "SELECT search_id, city, state, row_number() OVER "
          "(PARTITION BY search_id ORDER BY round(d, 6), city, state) AS rank FROM near", near=_NEAR))
def _(v):
    near = radius.within_radius(v.searches().select("search_id", "lat", "lon", "radius"), v.gazetteer(), whole=True)
    return radius.nearest_k(near).select("search_id", "city", "state", "rank")


@register("f12_trusted_portals", V.sql("portals", "SELECT city_key, url, fail_count FROM portals WHERE fail_count < 5"))
def _(v):
    return radius.trusted(v.portals()).select("city_key", "url", "fail_count")


_COVER = V.sql("gazetteer searches portals", """SELECT s.search_id, s.radius, (SELECT count(*) FROM near n WHERE n.search_id = s.search_id) AS agencies,
    (SELECT string_agg(city || ', ' || state, '; ' ORDER BY rk) FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(d, 6), city, state) AS rk FROM near) r
     WHERE r.search_id = s.search_id AND rk <= 8) AS nearest FROM searches s""", trusted=_TRUSTED, near=_REACH)


@register("a5_coverage", _COVER)
def _(v):
    return radius.coverage(v.searches().select("search_id", "lat", "lon", "radius"), v.gazetteer(), v.portals())


@register("a16_metro_reach", V.sql("gazetteer searches portals", f"""SELECT s.search_id, count(*) FILTER (WHERE d <= 50) AS within_near, count(d) AS within_far,
    CASE WHEN count(*) FILTER (WHERE d <= 50) >= 20 THEN 1 WHEN count(*) FILTER (WHERE d <= 50) >= 15 THEN 2 ELSE 3 END AS tier
    FROM searches s LEFT JOIN (SELECT s.search_id, {_DIST} AS d FROM searches s, gazetteer t WHERE {_DIST} <= 125 AND lower(t.city) || '|' || t.state IN (SELECT city_key FROM trusted)) n
    ON s.search_id = n.search_id GROUP BY s.search_id""", trusted=_TRUSTED))
def _(v):
    return radius.metro_reach(v.searches().select("search_id", "lat", "lon"), v.gazetteer(), v.portals())


@register("a24_metro_tiers", V.sql("gazetteer searches portals", f"""SELECT tier, count(*) AS metros FROM (SELECT s.search_id,
    CASE WHEN count(d) >= 20 THEN 1 WHEN count(d) >= 15 THEN 2 ELSE 3 END AS tier
    FROM searches s LEFT JOIN (SELECT s.search_id, {_DIST} AS d FROM searches s, gazetteer t WHERE {_DIST} <= 50 AND lower(t.city) || '|' || t.state IN (SELECT city_key FROM trusted)) n
    ON s.search_id = n.search_id GROUP BY s.search_id) GROUP BY tier""", trusted=_TRUSTED))
def _(v):
    return tally(radius.metro_reach(v.searches().select("search_id", "lat", "lon"), v.gazetteer(), v.portals()), "tier", name="metros")


@register("c8_sample_points", V.sql("searches", """SELECT search_id, ring, idx, round(bearing, 6) AS bearing, round(distance, 6) AS distance,
    round(degrees(asin(sin(radians(lat)) * cos(distance / 3958.8) + cos(radians(lat)) * sin(distance / 3958.8) * cos(radians(bearing)))), 6) AS lat,
    round(lon + degrees(atan2(sin(radians(bearing)) * sin(distance / 3958.8) * cos(radians(lat)), cos(distance / 3958.8) - sin(radians(lat)) * (sin(radians(lat)) * cos(distance / 3958.8) + cos(radians(lat)) * sin(distance / 3958.8) * cos(radians(bearing))))), 6) AS lon
    FROM (SELECT search_id, lat, lon, ring, idx, (idx * 360.0 / per) + ring * 180.0 / per AS bearing, CAST(radius AS DOUBLE) * CASE WHEN radius < 80 THEN 0.7 WHEN ring = 0 THEN 0.5 ELSE 0.85 END AS distance
      FROM (SELECT *, CASE WHEN radius < 80 THEN 1 ELSE 2 END AS rings, CASE radius WHEN 50 THEN 2 WHEN 75 THEN 4 ELSE 3 END AS per FROM searches WHERE radius >= 40) s,
      (VALUES (0), (1)) r(ring), (VALUES (0), (1), (2), (3), (4), (5)) i(idx) WHERE ring < rings AND idx < per)"""))
def _(v):
    p = radius.sample_points(v.searches())
    return p.select("search_id", "ring", "idx", *[F.round(c, 6).alias(c) for c in ("bearing", "distance", "lat", "lon")])


@register("j14_prune_hits_by_area", V.sql("gazetteer searches crawl", f"""SELECT h.search_id, h.url FROM (SELECT search_id, url, regexp_extract(url, '//(www\\.)?([^/:?#]+)', 2) AS host
      FROM hits) h JOIN searches s ON s.search_id = h.search_id
      LEFT JOIN idx t ON t.host = h.host WHERE t.lat IS NULL OR {_DIST} <= s.radius""",
          hits="SELECT l_suppkey AS search_id, url FROM lineitem JOIN pages ON page_id = l_partkey // 8 UNION ALL SELECT l_suppkey, bid_url FROM lineitem JOIN crawl ON row_ord = l_partkey WHERE bid_url <> ''",
          idx="SELECT regexp_replace(domain, '^www\\.', '') AS host, g.lat, g.lon FROM crawl c JOIN gazetteer g ON lower(g.city) = lower(c.city) AND g.state = c.state"))
def _(v):
    return _pruned(v)[1].select("search_id", "url")


def _pruned(v):
    """Hits on pages and on directory pages, and those left inside each search's area."""
    from noticegrid.operators import directory
    lines = v.table("lineitem").select(F.col("l_suppkey").alias("search_id"), F.col("l_partkey").alias("row_ord"), F.floor(F.col("l_partkey") / 8).alias("page_id"))
    hits = lines.join(v.table("pages").select("page_id", "url"), "page_id").select("search_id", "url").unionByName(
        lines.join(v.crawl().where("bid_url <> ''"), "row_ord").select("search_id", F.col("bid_url").alias("url")))
    s = v.searches().select("search_id", "lat", "lon", "radius")
    return hits, radius.prune_hits_by_area(hits, s, directory.domain_index(v.crawl()), v.gazetteer())


@register("a2_area_reasons", V.sql("gazetteer searches crawl", f"""SELECT search_id, count(*) AS hits, count(*) - any_value(coalesce(k, 0)) AS search_hit_out_of_area FROM hits
    LEFT JOIN (SELECT search_id, count(*) AS k FROM (SELECT h.search_id, h.url FROM (SELECT search_id, url, regexp_extract(url, '//(www\\.)?([^/:?#]+)', 2) AS host
      FROM hits) h JOIN searches s ON s.search_id = h.search_id
      LEFT JOIN idx t ON t.host = h.host WHERE t.lat IS NULL OR {_DIST} <= s.radius) GROUP BY 1) USING (search_id) GROUP BY search_id""",
          hits="SELECT l_suppkey AS search_id, url FROM lineitem JOIN pages ON page_id = l_partkey // 8 UNION ALL SELECT l_suppkey, bid_url FROM lineitem JOIN crawl ON row_ord = l_partkey WHERE bid_url <> ''",
          idx="SELECT regexp_replace(domain, '^www\\.', '') AS host, g.lat, g.lon FROM crawl c JOIN gazetteer g ON lower(g.city) = lower(c.city) AND g.state = c.state"))
def _(v):
    return radius.area_reasons(*_pruned(v))


# ---- placing ------------------------------------------------------------------------
_SNAP = """SELECT a.city, a.state, min(k.city) AS snapped FROM asked a JOIN gazetteer k ON k.state = a.state AND levenshtein(lower(a.city), lower(k.city)) = 1
    WHERE NOT EXISTS (SELECT 1 FROM gazetteer g WHERE g.state = a.state AND lower(g.city) = lower(a.city)) GROUP BY a.city, a.state HAVING count(DISTINCT k.city) = 1"""
_ASKED = """SELECT DISTINCT city, state FROM (SELECT trim(split_part(coalesce(nullif(city, ''), default_city), ',', 1)) AS city, town_state AS state FROM bids) WHERE city <> ''"""


@register("j9_snap_city", V.sql("gazetteer bids", "SELECT * FROM snap", asked=_ASKED, snap=_SNAP))
def _(v):
    b = placing.with_name_key(v.bids())
    names = b.select(F.col("_city").alias("city"), F.col("town_state").alias("state"))
    return placing.snap_city(names, v.gazetteer())


_PLACED = """SELECT r.*, coalesce(s.snapped, r.city0) AS place_city, CASE WHEN g.lat IS NOT NULL THEN r.town_state WHEN anchored THEN r.town_state END AS place_state,
    CASE WHEN g.lat IS NOT NULL THEN g.lat WHEN anchored THEN fallback_lat END AS lat, CASE WHEN g.lat IS NOT NULL THEN g.lon WHEN anchored THEN fallback_lon END AS lon,
    CASE WHEN city0 = '' THEN 'no_location' WHEN g.lat IS NOT NULL THEN NULL WHEN elsewhere THEN 'authority_in_another_state' WHEN anchored THEN NULL ELSE 'unresolvable_place' END AS drop_reason,
    s.snapped IS NOT NULL AS city_name_corrected, (city0 <> '' AND g.lat IS NULL AND NOT elsewhere AND anchored) AS placed_by_search_town
  FROM (SELECT *, stated = '' AND city0 LIKE '% County' AND lower(city0) <> lower(default_city) AND coalesce((SELECT count(DISTINCT q.state) = 1 AND min(q.state) <> town_state FROM registry q
            WHERE contains(regexp_replace(lower(q.org), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(q.domain), '[^a-z0-9]', '', 'g'), regexp_replace(lower(city0), '[^a-z0-9]', '', 'g'))), FALSE) AS elsewhere,
          (city0 LIKE '% County' OR (default_city <> '' AND lower(city0) = lower(default_city))) AND fallback_lat IS NOT NULL AS anchored
        FROM (SELECT *, trim(split_part(coalesce(nullif(city, ''), default_city), ',', 1)) AS city0, trim(split_part(coalesce(nullif(city, ''), default_city), ',', 2)) AS stated FROM bids)) r
  LEFT JOIN snap s ON s.city = r.city0 AND s.state = r.town_state
  LEFT JOIN gazetteer g ON g.state = r.town_state AND lower(g.city) = lower(regexp_replace(coalesce(s.snapped, r.city0), '^City of ', ''))"""
_P = dict(asked=_ASKED, snap=_SNAP, placed=_PLACED)


@register("j6_place_bids", V.sql("gazetteer registry bids", """SELECT bid_id, place_city, CASE WHEN drop_reason IS NULL THEN place_state END AS place_state, CASE WHEN drop_reason IS NULL THEN round(lat, 6) END AS lat, CASE WHEN drop_reason IS NULL THEN round(lon, 6) END AS lon, drop_reason, city_name_corrected, placed_by_search_town
    FROM (SELECT * REPLACE (CASE WHEN city0 = '' THEN NULL ELSE place_city END AS place_city) FROM placed)""", **_P))
def _(v):
    p = placing.place_bids(v.bids(), v.gazetteer(), v.registry())
    return p.select("bid_id", "place_city", "place_state", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
                    "drop_reason", "city_name_corrected", "placed_by_search_town")


@register("j7_anchor_fallback", V.sql("gazetteer registry bids", "SELECT bid_id, place_city, place_state FROM placed WHERE placed_by_search_town AND drop_reason IS NULL", **_P))
def _(v):
    p = placing.place_bids(v.bids(), v.gazetteer(), v.registry())
    return p.where("placed_by_search_town").select("bid_id", "place_city", "place_state")


@register("j8_authority_elsewhere", V.sql("registry bids", """SELECT DISTINCT b.city AS name, q.state FROM (SELECT DISTINCT city FROM bids WHERE city LIKE '% County') b JOIN registry q
    ON contains(regexp_replace(lower(q.org), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(q.domain), '[^a-z0-9]', '', 'g'), regexp_replace(lower(b.city), '[^a-z0-9]', '', 'g'))"""))
def _(v):
    from noticegrid.operators import directory
    names = v.bids().where(places.county_shaped("city")).select(F.col("city").alias("name"))
    return directory.states_for_org(names, v.registry())


_FUNNEL_P = """SELECT reason, count(*) AS n FROM (SELECT coalesce(drop_reason, 'placed') AS reason FROM placed UNION ALL SELECT 'city_name_corrected' FROM placed WHERE city_name_corrected
    UNION ALL SELECT 'placed_by_search_town' FROM placed WHERE placed_by_search_town AND drop_reason IS NULL) GROUP BY reason"""


@register("a2_placement_funnel", V.sql("gazetteer registry bids", _FUNNEL_P, **_P))
def _(v):
    return placing.placement_funnel(placing.place_bids(v.bids(), v.gazetteer(), v.registry()))


@register("p12_resolve_location", V.sql("towns", """SELECT t.search_id, t.kind, round(CASE t.kind WHEN 0 THEN t.lat WHEN 1 THEN z.lat WHEN 2 THEN t.glat WHEN 3 THEN t.glat END, 6) AS lat,
    CASE WHEN t.kind = 0 THEN '' WHEN t.kind = 1 THEN z.city ELSE t.gcity END AS city
  FROM (SELECT t.town_id AS search_id, t.town_id % 5 AS kind, t.lat, g.lat AS glat, g.city AS gcity, lpad(CAST(t.town_id AS VARCHAR), 5, '0') AS zip FROM towns t LEFT JOIN (SELECT * FROM towns WHERE town_id % 50 <> 49) g USING (town_id)) t
  LEFT JOIN (SELECT * FROM towns WHERE town_id % 3 <> 0) z ON z.town_id = t.search_id
  WHERE CASE t.kind WHEN 0 THEN TRUE WHEN 1 THEN z.lat IS NOT NULL WHEN 2 THEN t.glat IS NOT NULL WHEN 3 THEN t.glat IS NOT NULL ELSE FALSE END"""))
def _(v):
    from noticegrid import vocab
    names = F.create_map(*[F.lit(x) for kv in vocab.STATE_NAMES.items() for x in kv])
    k = F.col("town_id")
    loc = (F.when(k % 5 == 0, F.concat(F.col("lat").cast("decimal(12,6)").cast("string"), F.lit(", "), F.col("lon").cast("decimal(12,6)").cast("string")))
           .when(k % 5 == 1, F.lpad(k.cast("string"), 5, "0")).when(k % 5 == 2, F.concat_ws(", ", "city", "state"))
           .when(k % 5 == 3, F.concat_ws(", ", "city", F.try_element_at(names, F.col("state")))).otherwise(F.lit("somewhere")))
    t = v.towns()
    zips = t.where("town_id % 3 <> 0").select(F.lpad(k.cast("string"), 5, "0").alias("zip"), "lat", "lon", "city", "state")
    found = placing.resolve_locations(t.select(k.alias("search_id"), (k % 5).alias("kind"), loc.alias("location")), v.gazetteer(), zips)
    return found.where("lat is not null").select("search_id", "kind", F.round("lat", 6).alias("lat"), "city")


# ---- scan ---------------------------------------------------------------------------
_NICHE = "('sidewalk', 'ada ramp', 'ada', 'curb', 'gutter', 'concrete', 'flatwork')"
_CLOSED = "regexp_matches(lower({0}), 'closed|close date|awarded|award to|cancel|expired|withdrawn|archived|no longer|not accepting|complete|planned|upcoming|anticipated')"
_AGED = f"""SELECT p.*, CASE WHEN NOT {_CLOSED.format('st1')} AND due_date IS NULL AND since <= DATE '2006-06-02' THEN TRUE ELSE FALSE END AS aged_out FROM (
    SELECT p.*, j.status_now AS st1, CASE WHEN p.published <> '' THEN CAST(p.published AS DATE) WHEN p.bid_id % 3 = 0 AND p.bid_id % 20 > 6 THEN DATE '2006-05-01' END AS since FROM placed p JOIN judged j USING (bid_id) WHERE drop_reason IS NULL) p"""
_STATUS2 = "CASE WHEN aged_out THEN 'Closed' ELSE st1 END"
_SCORED = f"""SELECT *, CASE WHEN {_CLOSED.format('st3')} THEN -100 WHEN due_date IS NULL THEN 0 WHEN due_date < DATE '2006-08-01' THEN -50 ELSE greatest(0, 30 - least(date_diff('day', DATE '2006-08-01', due_date), 30)) END
    + 2 * (SELECT count(*) FROM (VALUES ('sidewalk'), ('ada ramp'), ('ada'), ('curb'), ('gutter'), ('concrete'), ('flatwork')) w(k) WHERE contains(lower(title || ' ' || scope), k))
    + CASE WHEN email <> '' OR phone <> '' THEN 3 ELSE 0 END + CASE WHEN value <> '' THEN 1 ELSE 0 END AS score
  FROM (SELECT *, CASE WHEN trim(deadline) = '' AND NOT {_CLOSED.format('st2')} AND contains(scope, '2004') THEN 'Closed' ELSE st2 END AS st3 FROM (SELECT *, {_STATUS2} AS st2 FROM aged))"""
_HIT = f"""SELECT s.search_id, s.state AS centre_state, b.*, CASE WHEN b.place_state = s.state THEN b.place_city ELSE b.place_city || ', ' || b.place_state END AS label,
    {V.sql_distance('s.lat', 's.lon', 'b.lat', 'b.lon')} AS d FROM searches s JOIN scored b ON {V.sql_distance('s.lat', 's.lon', 'b.lat', 'b.lon')} <= s.radius"""
_KEPT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_id, label, CASE WHEN title = '' THEN CAST(bid_id AS VARCHAR) ELSE '' END, lower(title), lower(trim(deadline)) ORDER BY seq) AS dup FROM hit) WHERE dup = 1"""
_SCAN = dict(_P, aged=_AGED, scored=_SCORED, hit=_HIT, kept=_KEPT)
_SCAN_VIEWS = "gazetteer registry searches judged"


def prepared(v, **kw):
    # bids that state their town plainly were first seen on one day
    seen = v.bids().where("bid_id % 3 = 0 and bid_id % 20 > 6").select(
        keys.bid_signature(F.concat_ws(", ", "town", "town_state"), "title", "deadline", "url").alias("sig"),
        F.lit("2006-05-01").cast("date").alias("seen_date"))
    return scan.prepare(v.bids(), v.gazetteer(), v.registry(), V.as_of(), first_seen=seen, **kw)


def centres(v):
    return v.searches().select("search_id", "lat", "lon", "state", "radius", "city")


@register("b1_scan", V.sql(_SCAN_VIEWS, """SELECT search_id, label, bid_id, round(d, 6) AS distance_mi, st3 AS status, score,
    row_number() OVER (PARTITION BY search_id, label ORDER BY score DESC, seq) AS rank FROM kept""", **_SCAN))
def _(v):
    rows = scan.scan(centres(v), prepared(v))
    return rows.select("search_id", "label", "bid_id", F.round("distance_mi", 6).alias("distance_mi"), "status", "score", "rank")


def half_the_pages(v):
    """Posting pages for every second bid, with only a phone number on them."""
    blank = [F.lit("").alias(c) for c in bid_ops.DETAIL_FIELDS if c != "phone"]
    return v.bids().where("bid_id % 2 = 0").select("url", F.lit("(417) 864-1976").alias("phone"), *blank,
                                                   F.lit(False).alias("addenda"), F.array().cast("array<string>").alias("documents"))


@register("b1_scan_enriched", V.sql(_SCAN_VIEWS, f"""SELECT search_id, label, bid_id, score + CASE WHEN enriched AND score > -100 THEN 3 WHEN enriched THEN 3 ELSE 0 END AS score, enriched FROM (
    SELECT k.*, coalesce(bid_id % 2 = 0, FALSE) AND email = '' AND phone = '' AS enriched FROM kept k LEFT JOIN (SELECT search_id, bid_id, row_number() OVER (PARTITION BY search_id ORDER BY CASE WHEN trim(deadline) = '' THEN 0 ELSE 1 END, seq) AS rn
      FROM kept WHERE email = '' AND phone = '') t USING (search_id, bid_id))""", **_SCAN))
def _(v):
    p = prepared(v, details=half_the_pages(v))
    rows = scan.scan(centres(v), p, columns=["phone"])
    wide = scan.attach(rows, p, ["phone"])
    return wide.select("search_id", "label", "bid_id", "score", (F.col("enriched") & (F.col("phone") == "(417) 864-1976")).alias("enriched"))


@register("a2_contact_reasons", V.sql(_SCAN_VIEWS, """SELECT search_id, reason, count(*) AS n FROM (
    SELECT search_id, CASE WHEN email <> '' OR phone <> '' OR bid_id % 2 = 0 THEN 'contacts_found' ELSE 'contacts_missing' END AS reason FROM kept
    UNION ALL SELECT search_id, unnest(CASE WHEN bid_id % 2 = 0 THEN ['postings_read', 'postings_enriched'] ELSE ['postings_unreachable'] END) FROM kept WHERE email = '' AND phone = '') GROUP BY ALL""", **_SCAN))
def _(v):
    p = prepared(v, details=half_the_pages(v))
    return scan.contact_reasons(scan.scan(centres(v), p, ranked=False), p)


@register("a2_intake_reasons", V.sql("bids", f"""SELECT source, reason, count(*) AS n FROM (SELECT 'portals' AS source, CASE WHEN bid_id % 9 = 0 THEN 'malformed' WHEN NOT ({RELEVANT_TITLE}) THEN 'filtered_not_niche' ELSE 'taken' END AS reason
    FROM bids UNION ALL SELECT 'agency_posted', 'agency_posted' FROM bids WHERE contains(lower(title), 'janitorial')) GROUP BY ALL"""))
def _(v):
    b = v.bids().withColumn("scope", F.lit(""))
    plain = b.withColumn("source", F.lit("portals"))
    blank = lambda c: F.when(F.col("bid_id") % 9 == 0, F.lit(" ")).otherwise(F.col(c))
    posted = b.where("contains(lower(title), 'janitorial')").withColumn("source", F.lit("agency_posted"))
    return bid_ops.intake_reasons(plain.withColumns({"title": blank("title"), "url": blank("url")}).unionByName(posted))


@register("b1_scan_funnel", V.sql(_SCAN_VIEWS, f"""SELECT search_id, reason, n FROM (
    SELECT s.search_id, 'out_of_radius' AS reason, (SELECT count(*) FROM scored) - count(h.bid_id) AS n FROM searches s LEFT JOIN hit h USING (search_id) GROUP BY s.search_id
    UNION ALL SELECT search_id, 'aged_out_undated', count(*) FROM hit WHERE aged_out GROUP BY search_id
    UNION ALL SELECT h.search_id, 'duplicate', count(*) - any_value(k.n) FROM hit h JOIN (SELECT search_id, count(*) AS n FROM kept GROUP BY search_id) k USING (search_id) GROUP BY h.search_id
    UNION ALL SELECT search_id, 'kept', count(*) FROM kept GROUP BY search_id
    UNION ALL SELECT search_id, 'kept_but_closed', count(*) FROM kept WHERE {_CLOSED.format('st3')} GROUP BY search_id) WHERE n > 0""", **_SCAN))
def _(v):
    p = prepared(v)
    n = p.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_placed"))
    return scan.scan_funnel(centres(v), scan.scan(centres(v), p, ranked=False), n)


@register("a4_open_total", V.sql(_SCAN_VIEWS, f"SELECT search_id, count(*) FILTER (WHERE NOT {_CLOSED.format('st3')}) AS open_total, count(*) FILTER (WHERE {_CLOSED.format('st3')}) AS kept_closed FROM kept GROUP BY search_id", **_SCAN))
def _(v):
    return bid_ops.open_totals(scan.scan(centres(v), prepared(v), ranked=False), "search_id")


@register("a3_status_breakdown", V.sql(_SCAN_VIEWS, "SELECT search_id, coalesce(nullif(trim(st3), ''), '(none)') AS status, count(*) AS n FROM kept GROUP BY ALL", **_SCAN))
def _(v):
    return bid_ops.status_breakdown(scan.scan(centres(v), prepared(v), ranked=False), "search_id")


@register("w11_scan_sample", V.sql(_SCAN_VIEWS, f"""SELECT search_id, label AS city, title, deadline, st3 AS status, NOT {_CLOSED.format('st3')} AS open FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY label, seq) AS rn FROM kept) WHERE rn <= 8""", **_SCAN))
def _(v):
    p = prepared(v)
    return scan.sample(scan.scan(centres(v), p, ranked=False), p)


@register("b2_upcoming", V.sql(_SCAN_VIEWS, """SELECT search_id, label, bid_id, CASE WHEN status_now = 'Closed' THEN 'Closed' ELSE 'Planned' END AS status FROM (
    SELECT k.search_id, k.label, k.bid_id, j.status_now FROM kept k JOIN (SELECT bid_id, CASE WHEN due_date IS NOT NULL AND CASE WHEN contains(deadline, '2:00 PM CST') THEN CAST(due_date AS TIMESTAMP) + INTERVAL 20 HOUR < TIMESTAMP '2006-08-01 12:00:00' ELSE due_date < DATE '2006-08-01' END THEN 'Closed' WHEN starts_with(deadline, 'FY') AND CAST(substr(deadline, 3, 4) AS INTEGER) < 2006 THEN 'Closed' END AS status_now FROM bids) j USING (bid_id))""", **_SCAN))
def _(v):
    rows, _ = scan.upcoming(centres(v), v.bids(), v.gazetteer(), v.registry(), V.as_of())
    return rows.select("search_id", "label", "bid_id", "status")


@register("b11_coverage", _COVER)
def _(v):
    named = v.searches().select("search_id", "radius", F.concat_ws(", ", "lat", "lon").alias("location"))
    zips = v.gazetteer().select(F.lit("none").alias("zip"), "lat", "lon", "city", "state").limit(0)
    found = placing.resolve_locations(named, v.gazetteer(), zips)
    return radius.coverage(found.select("search_id", "lat", "lon", "radius"), v.gazetteer(), v.portals())


# ---- alerts -------------------------------------------------------------------------
_SIG = "substr(sha256(label || '|' || title || '|' || deadline || '|' || url), 1, 16)"
_CURRENT = f"SELECT *, {_SIG} AS sig FROM (SELECT *, row_number() OVER (PARTITION BY search_id, label ORDER BY score DESC, seq) AS rank FROM kept) WHERE NOT {_CLOSED.format('st3')}"
_ALERT = dict(_SCAN, cur=_CURRENT, seen="SELECT search_id, sig FROM cur WHERE bid_id % 4 = 0", fresh="SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.search_id = cur.search_id AND s.sig = cur.sig)")


def _alerts(v):
    p = prepared(v)
    rows = scan.scan(centres(v), p, apart=True)
    seen = alerts.current_signatures(rows).where("bid_id % 4 = 0").pairs("sig")
    return alerts.alerts(rows, p, seen)


@register("j19_new_for_subscriber", V.sql(_SCAN_VIEWS, "SELECT search_id, label, bid_id, sig FROM fresh", **_ALERT))
def _(v):
    """Against a store that an earlier run left in buckets."""
    current = alerts.current_signatures(scan.scan(centres(v), prepared(v), apart=True)).each(lambda rows: base_stage(rows, "current"))
    table = f"seen_{uuid.uuid4().hex}"
    path = f"{run_folder(v.spark)}/{table}"
    alerts.write_seen(current.where("bid_id % 4 = 0").pairs("sig"), table, path)
    return alerts.new_for_subscriber(current, alerts.read_seen(v.spark, table, path)).pairs("label", "bid_id", "sig")


@register("w12_alert_digest", V.sql(_SCAN_VIEWS, """SELECT search_id, any_value(n) AS n_new, string_agg('- ' || CASE WHEN title = '' THEN 'Untitled' ELSE title END || ' — ' || label || CASE WHEN deadline = '' THEN '' ELSE ' (due ' || deadline || ')' END || chr(10) || '  ' || url, chr(10) ORDER BY rn)
    || CASE WHEN any_value(n) > 20 THEN chr(10) || '...and ' || CAST(any_value(n) - 20 AS VARCHAR) || ' more.' ELSE '' END AS body
    FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY label, rank, bid_id) AS rn, count(*) OVER (PARTITION BY search_id) AS n FROM fresh) WHERE rn <= 20 GROUP BY search_id""", **_ALERT))
def _(v):
    return _alerts(v)["digest"]


@register("b4_alerts", V.sql(_SCAN_VIEWS, "SELECT search_id, count(*) AS n_new FROM fresh GROUP BY search_id", **_ALERT))
def _(v):
    return _alerts(v)["digest"].select("search_id", "n_new")


@register("w13_seen_cap", V.sql(_SCAN_VIEWS, "SELECT search_id, sig, ord FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY label DESC, rank DESC, bid_id DESC) AS ord FROM cur) WHERE ord <= 300", **_ALERT))
def _(v):
    return alerts.seen_after(_alerts(v)["current"], 300)


@register("w13_seen_after", V.sql(_SCAN_VIEWS, "SELECT DISTINCT search_id, sig FROM cur", **_ALERT))
def _(v):
    return _alerts(v)["seen"]


_PLAN = "SELECT k.*, substr(sha256(label || '|' || title || '|' || deadline || '|' || url), 1, 16) AS sig FROM kept k"
_PLANNED = dict(_SCAN, cur=_PLAN, fresh="SELECT * FROM cur WHERE bid_id % 3 <> 0")


@register("b4_alerts_upcoming", V.sql(_SCAN_VIEWS, "SELECT search_id, label, bid_id, sig FROM fresh", **_PLANNED))
def _(v):
    rows, p = scan.upcoming(centres(v), v.bids(), v.gazetteer(), v.registry(), V.as_of(), apart=True)
    seen = alerts.current_signatures(rows, open_only=False).where("bid_id % 3 = 0").pairs("sig")
    return alerts.alerts(rows, p, seen, kind="upcoming")["new"].select("search_id", "label", "bid_id", "sig")
