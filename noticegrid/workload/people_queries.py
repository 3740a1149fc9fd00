"""Leads, feeds and accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions import leads as L
from noticegrid.operators import feed, health, ledger, radius
from noticegrid.plans import discovery
from noticegrid.workload import views as V
from noticegrid.workload.directory_queries import saved
from noticegrid.workload.registry import register

# ---- permits to leads ---------------------------------------------------------------
_LABEL = "CASE lt " + " ".join("WHEN '{}' THEN '{}'".format(k, t.replace("'", "''")) for k, t in vocab.LEAD_LABELS.items()) + " END"


def _orders(v):
    return v.table("orders").withColumn("k", F.col("o_orderkey")).withColumn("key", F.col("k").cast("string"))


@register("p1_leads_austin", f"""SELECT permit_id, address, contractor_name, lat, lead_type, {_LABEL.replace('lt', 'lead_type', 1)} AS lead_type_label FROM (SELECT 'P' || o_orderkey AS permit_id, CASE WHEN o_orderkey % 2 = 0 THEN '1 Main' ELSE '2 Oak' END AS address,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Homes Inc' WHEN o_orderkey % 3 = 1 THEN 'Jo Poe' ELSE '' END AS contractor_name, CASE WHEN o_orderkey % 4 = 0 THEN 30.5 WHEN o_orderkey % 4 = 1 THEN 31.5 END AS lat,
    CASE WHEN o_orderkey % 5 = 0 THEN 'builder' WHEN o_orderkey % 5 = 1 THEN 'taken' WHEN o_orderkey % 5 = 2 THEN 'unknown' ELSE 'open' END AS lead_type FROM orders)""")
def _(v):
    k = F.col("k")
    raw = _orders(v).select(
        F.concat(F.lit("P"), "key").alias("permit_number"), F.when(k % 2 == 0, F.lit("1 Main")).alias("permit_location"), F.lit("2 Oak").alias("original_address1"),
        F.lit("Driveway").alias("permit_type_desc"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("issue_date"), F.lit("Active").alias("status_current"),
        F.when(k % 3 == 0, F.lit("Homes Inc")).otherwise(F.lit("")).alias("contractor_company_name"), F.when(k % 3 == 1, F.lit("Jo Poe")).alias("contractor_full_name"),
        F.when(k % 5 == 0, F.lit("General Contractor")).when(k % 5 == 1, F.lit("Concrete")).when(k % 5 == 2, F.lit("Plumbing")).alias("contractor_trade"),
        F.when(k % 4 == 0, F.lit("30.5")).when(k % 4 == 2, F.lit("n/a")).alias("latitude"), F.lit("-97.1").alias("longitude"),
        F.struct(F.when(k % 4 == 1, F.lit("31.5")).alias("latitude"), F.lit("-97.2").alias("longitude")).alias("location"), F.struct(F.lit("http://x").alias("url")).alias("link"))
    return L.leads_austin(raw).select("permit_id", "address", "contractor_name", "lat", "lead_type", "lead_type_label")


@register("p2_leads_cambridge", "SELECT 'C' || o_orderkey AS permit_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Curb cut / driveway approach, 12 ft wide' ELSE 'Curb cut permit' END AS description, strftime(o_orderdate, '%Y-%m-%d') AS issued_date, 'open' AS lead_type FROM orders")
def _(v):
    raw = _orders(v).select(F.concat(F.lit("C"), "key").alias("id"), F.lit("1 Elm").alias("full_address"), F.lit("42.3").alias("latitude"), F.lit("").alias("longitude"), F.lit("x").alias("status"),
                            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("applicant_submit_date"), F.when(F.col("k") % 2 == 0, F.lit("12")).alias("driveway_width"),
                            F.lit(None).cast("string").alias("permit_type"), F.lit("Al").alias("applicant_name"))
    return L.leads_cambridge(raw).select("permit_id", "description", "issued_date", "lead_type")


@register("p3_leads_baton_rouge", "SELECT 'B' || o_orderkey AS permit_id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN '' WHEN o_orderkey % 4 = 2 THEN 'ABC Concrete LLC' ELSE 'Sam Builder' END AS contractor_name, CASE o_orderkey % 4 WHEN 2 THEN 'concrete' WHEN 3 THEN 'builder' ELSE '' END AS contractor_trade, CASE o_orderkey % 4 WHEN 2 THEN 'taken' WHEN 3 THEN 'builder' ELSE 'open' END AS lead_type FROM orders")
def _(v):
    raw = _orders(v).select(F.concat(F.lit("B"), "key").alias("permitid"), F.lit("Driveway").alias("permittype"), F.lit("d").alias("projectdescription"), F.lit("2001-01-01").alias("issueddate"),
                            F.lit("1 Rue").alias("streetaddress"), F.lit("70801").alias("zip"), F.lit("").alias("ownername"), F.lit("Ann Roy").alias("applicantname"),
                            V.pick(["N/A", " ANN ROY", "ABC Concrete LLC", "Sam Builder"], F.col("k") % 4).alias("contractorname"), F.lit("30.4").alias("lat"), F.lit("-91.1").alias("long"))
    return L.leads_baton_rouge(raw).select("permit_id", "contractor_name", "contractor_trade", "lead_type")


@register("w6_lead_rank", V.sql("leads", """SELECT permit_id, row_number() OVER (PARTITION BY state ORDER BY CASE lt WHEN 'open' THEN 0 WHEN 'builder' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, issued_date DESC, seq) AS rank
    FROM (SELECT *, CASE WHEN contractor_trade = '' THEN 'open' ELSE lead_type END AS lt FROM leads)"""))
def _(v):
    from noticegrid.operators.common import rank_all
    rows = L.with_lead_type(v.leads()).withColumn("priority", L.lead_priority("lead_type"))
    newest = -F.unix_date(F.col("issued_date").cast("date"))
    return rank_all(rows.select("permit_id", "state", "priority", "issued_date", "seq"), ["state"], [F.col("priority"), newest], [F.col("priority"), newest, F.col("seq")]).select("permit_id", "rank")


@register("w9_leads_newest", V.sql("leads", "SELECT permit_id, issued_date, row_number() OVER (PARTITION BY state ORDER BY issued_date DESC, seq) AS place FROM leads"))
def _(v):
    return feed.leads_newest(v.leads().withColumn("user_id", F.col("state"))).select("permit_id", "issued_date", "place")


_ZIPS = "SELECT lpad(CAST(town_id % 100000 AS VARCHAR), 5, '0') AS zip, min(lat) AS lat, min(lon) AS lon FROM towns WHERE town_id % 4 <> 0 GROUP BY 1"


def _zips(v):
    return v.towns().where("town_id % 4 <> 0").select(F.lpad((F.col("town_id") % 100000).cast("string"), 5, "0").alias("zip"), "lat", "lon")


_OFFER = "SELECT s.search_id, s.radius, s.lat AS clat, s.lon AS clon, l.* FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) i JOIN searches s ON s.search_id = i.l_suppkey JOIN leads l ON l.seq = i.l_orderkey"


@register("j16_leads_in_radius", V.sql("towns searches leads", f"""SELECT o.search_id, o.permit_id FROM offer o LEFT JOIN zips z ON z.zip = o.zip
    WHERE coalesce({V.sql_distance('o.clat', 'o.clon', 'CASE WHEN o.lat IS NOT NULL THEN o.lat ELSE z.lat END', 'CASE WHEN o.lat IS NOT NULL THEN o.lon ELSE z.lon END')} <= o.radius * 8, TRUE)""", zips=_ZIPS, offer=_OFFER))
def _(v):
    s = v.searches().select("search_id", (F.col("radius") * 8).alias("radius"), "lat", "lon")
    offered = v.table("lineitem").select(F.col("l_suppkey").alias("search_id"), F.col("l_orderkey").alias("seq")).distinct()
    return radius.leads_in_radius(offered, s, v.leads().select("seq", "permit_id", "zip", "lat", "lon"), _zips(v), "seq").select("search_id", "permit_id")


_SRC = "SELECT DISTINCT city, state, lat, lon, town_id FROM towns WHERE town_id % 5 = 0"


def _sources(v):
    return v.towns().where("town_id % 5 = 0").select(F.col("town_id").alias("source_ord"), "city", "state", "lat", "lon")


@register("j15_nearby_lead_sources", V.sql("towns searches", f"SELECT s.search_id, t.city FROM searches s JOIN src t ON {V.sql_distance('s.lat', 's.lon', 't.lat', 't.lon')} <= s.radius + 25", src=_SRC))
def _(v):
    return radius.nearby_lead_sources(v.searches().select("search_id", "lat", "lon", "radius"), _sources(v)).select("search_id", "city")


_B3 = f"""SELECT s.search_id, l.permit_id, t.town_id AS source_ord,
    row_number() OVER (PARTITION BY s.search_id ORDER BY CASE CASE WHEN l.contractor_trade = '' THEN 'open' ELSE l.lead_type END WHEN 'open' THEN 0 WHEN 'builder' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, l.issued_date DESC, l.seq, t.town_id) AS rank FROM searches s JOIN src t ON {V.sql_distance('s.lat', 's.lon', 't.lat', 't.lon')} <= s.radius + 25
    JOIN leads l ON l.city = t.city AND l.state = t.state LEFT JOIN zips z ON z.zip = l.zip WHERE coalesce({V.sql_distance('s.lat', 's.lon', 'CASE WHEN l.lat IS NOT NULL THEN l.lat ELSE z.lat END', 'CASE WHEN l.lat IS NOT NULL THEN l.lon ELSE z.lon END')} <= s.radius, TRUE)"""


@register("b3_residential_leads", V.sql("towns searches leads", _B3, zips=_ZIPS, src=_SRC))
def _(v):
    thin = L.with_lead_type(v.leads()).select("permit_id", "seq", "city", "state", "zip", "issued_date", "lat", "lon", "lead_type")
    return discovery.residential_leads(v.searches(), thin, _sources(v), _zips(v)).select("search_id", "permit_id", "source_ord", "rank")


_NEARBY = "SELECT s_suppkey AS search_id, CASE WHEN s_suppkey % 2 = 0 THEN 30.2672 + (s_suppkey % 7) / 10.0 ELSE 42.3736 END AS lat, CASE WHEN s_suppkey % 2 = 0 THEN -97.7431 ELSE -71.1097 + (s_suppkey % 5) / 2.0 END AS lon, 25 AS radius FROM supplier"
_PERMIT = """SELECT 0 AS source_ord, 'P' || o_orderkey AS permit_id, o_orderdate AS d, CASE WHEN o_orderkey % 4 = 0 THEN 30.2 + (o_orderkey % 90) / 100.0 END AS lat, CASE WHEN o_orderkey % 4 = 0 THEN -97.7 END AS lon, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS prio
    FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate >= DATE '2001-07-20' - INTERVAL 45 DAY
    UNION ALL SELECT 1, 'C' || o_orderkey, o_orderdate, 42.3, -71.1, 0 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderdate >= DATE '2001-07-20' - INTERVAL 270 DAY"""


@register("b3_leads_from_permits", V.sql("", f"""SELECT s.search_id, p.permit_id, p.source_ord, row_number() OVER (PARTITION BY s.search_id ORDER BY prio, d DESC, permit_id, source_ord) AS rank
    FROM nearby s JOIN permit p ON CASE p.source_ord WHEN 0 THEN {V.sql_distance('s.lat', 's.lon', '30.2672', '-97.7431')} ELSE {V.sql_distance('s.lat', 's.lon', '42.3736', '-71.1097')} END <= s.radius + 25
    WHERE coalesce({V.sql_distance('s.lat', 's.lon', 'p.lat', 'p.lon')} <= s.radius, TRUE)""", nearby=_NEARBY, permit=_PERMIT))
def _(v):
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00.000")
    orders, at = v.table("orders"), lambda c: F.when(k % 4 == 0, c.cast("string")).otherwise(F.lit(""))
    austin = orders.select(F.concat(F.lit("P"), key).alias("permit_number"), F.lit("1 Main").alias("permit_location"),
                           F.when(k % 2 == 0, F.lit("Driveway / Sidewalks")).otherwise(F.lit("Plumbing")).alias("permit_type_desc"), day.alias("issue_date"),
                           F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("Sam Poe")).alias("contractor_company_name"), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("General Contractor")).alias("contractor_trade"),
                           at(F.lit(30.2) + (k % 90) / 100.0).alias("latitude"), at(F.lit(-97.7)).alias("longitude"))
    cambridge = orders.where("o_orderkey % 5 = 0").select(F.concat(F.lit("C"), key).alias("id"), F.lit("1 Elm").alias("full_address"), F.lit("42.3").alias("latitude"), F.lit("-71.1").alias("longitude"),
                                                          F.lit("x").alias("status"), day.alias("applicant_submit_date"), F.lit("12").alias("driveway_width"),
                                                          F.lit(None).cast("string").alias("permit_type"), F.lit("").alias("applicant_name"))
    s = F.col("s_suppkey")
    searches = v.table("supplier").select(s.alias("search_id"), F.when(s % 2 == 0, F.lit(30.2672) + (s % 7) / 10.0).otherwise(F.lit(42.3736)).alias("lat"),
                                          F.when(s % 2 == 0, F.lit(-97.7431)).otherwise(F.lit(-71.1097) + (s % 5) / 2.0).alias("lon"), F.lit(25).alias("radius"))
    rows = discovery.leads_for_searches(searches, {"austin": austin, "cambridge": cambridge}, _zips(v), F.lit("2001-07-20").cast("timestamp"))
    return rows.select("search_id", "permit_id", "source_ord", "rank")


@register("u5_multi_source_leads", V.sql("leads", "SELECT 0 AS source_ord, permit_id, contractor_name FROM leads UNION ALL SELECT 1, permit_id, NULL FROM leads"))
def _(v):
    from noticegrid.operators.bids import normalize_opportunities
    both = normalize_opportunities([("austin", v.leads()), ("cambridge", v.leads().drop("contractor_name"))])
    return both.select(F.col("source_priority").alias("source_ord"), "permit_id", "contractor_name")


def user_leads(v):
    return v.leads().withColumn("user_id", F.concat(F.lit("u"), (F.col("seq") % 30).cast("string")))


@register("f16_leads_filter", V.sql("leads", "SELECT permit_id FROM leads WHERE outreach = 'called' AND contains(lower(address || ' ' || description || ' ' || contractor_name || ' ' || city), 'firm 1')"))
def _(v):
    rows = user_leads(v)
    joined = feed.with_outreach(rows.drop("outreach"), rows.select("user_id", "permit_id", "outreach"))
    return feed.leads_filter(joined, "called", "Firm 1").select("permit_id")


@register("a10_lead_status_tiles", V.sql("leads", "SELECT 'u' || CAST(seq % 30 AS VARCHAR) AS user_id, CASE WHEN outreach = '' THEN 'none' ELSE outreach END AS status, count(*) AS n FROM leads GROUP BY ALL"))
def _(v):
    return feed.lead_status_tiles(user_leads(v))


@register("a13_category_profile", V.sql("leads bids", """SELECT 'permits' AS dataset, 'work_type' AS field, 'Driveway Curb Cut' AS value, count(*) AS n FROM leads WHERE seq % 3 = 1 HAVING count(*) >= 3
    UNION ALL SELECT 'notices', 'description', v, n FROM (SELECT lower(title) AS v, count(*) AS n FROM bids GROUP BY 1 HAVING n >= 3 AND regexp_matches(v, 'driveway|sidewalk|curb cut|curb ramp|curb & gutter') ORDER BY n DESC, v LIMIT 1)
    UNION ALL SELECT 'parts', 'TYPE_CODE', 'sidewalk brick ' || (p_size % 5), count(*) AS n FROM part WHERE p_size % 5 = 2 GROUP BY 3 HAVING n >= 3
    UNION ALL SELECT 'lines', 'class', 'Curb ramp', count(*) FROM lineitem WHERE l_linenumber = 2 HAVING count(*) >= 3"""))
def _(v):
    """Six data sets of unlike columns; one has no place, one no such column, one only values of other trades in its first field."""
    k = F.col("seq") % 3
    permits = v.leads().select("address", F.concat(F.lit("s"), k.cast("string")).alias("status_type"), F.lit("Residential").alias("permit_class"),
                               F.when(k == 1, F.lit("Driveway Curb Cut")).otherwise(F.lit("Roof")).alias("work_type"))
    notices = v.bids().select("bid_id", F.lit(1.5).alias("site_latitude"), F.lit(2).alias("site_longitude"), F.lower("title").alias("description"))
    parts = v.table("part").select(F.concat(F.lit("sidewalk brick "), (F.col("p_size") % 5).cast("string")).alias("TYPE_CODE"), F.col("p_name").alias("Address"),
                                   F.when(F.col("p_size") % 5 == 2, F.lit("driveway")).alias("workplan")).where("p_size % 5 = 2")
    lines = v.table("lineitem").select(F.when(F.col("l_linenumber") == 2, F.lit("Curb ramp")).otherwise(F.col("l_returnflag")).alias("class"), "l_linenumber", F.lit("x").alias("mail_address"))
    nowhere = v.table("orders").select(F.lit("sidewalk").alias("work_type"), "o_orderkey")
    plain = v.table("customer").select(F.lit("sidewalk").alias("city_type"), F.col("c_name").alias("address"))
    sets = {"permits": permits, "notices": notices, "parts": parts, "lines": lines, "nowhere": nowhere, "plain": plain}
    catalog = v.spark.createDataFrame([(name, df.columns) for name, df in sets.items()], "dataset string, columns array<string>")
    rows = [df.select(F.lit(name).alias("dataset"), F.to_variant_object(F.struct(*df.columns)).alias("row")) for name, df in sets.items()]
    return health.category_profile(reduce(DataFrame.unionByName, rows), catalog)


# ---- feeds --------------------------------------------------------------------------
def user_bids(v):
    return v.bids().drop("city").withColumnRenamed("town", "city").withColumns({
        "user_id": F.concat(F.lit("u"), (F.col("bid_id") % 30).cast("string")), "rank": F.col("bid_id").cast("int")})


def user_saved(v):
    return saved(v).withColumn("user_id", F.concat(F.lit("u"), (F.col("bid_id") % 30).cast("string")))


_U = "'u' || CAST(bid_id % 30 AS VARCHAR)"


@register("a7_feed_stats", V.sql("bids", f"SELECT {_U} AS user_id, count(*) AS total, count(*) FILTER (WHERE lower(status) = 'open') AS open_now, count(DISTINCT town) AS towns, count(*) FILTER (WHERE bid_id % 4 = 0) AS saved FROM bids GROUP BY 1"))
def _(v):
    return feed.feed_stats(user_bids(v), user_saved(v).where("bid_id % 4 = 0"))


@register("a8_city_tiles", V.sql("bids", f"SELECT user_id, city, n FROM (SELECT {_U} AS user_id, town AS city, count(*) AS n FROM bids GROUP BY 1, 2 UNION ALL SELECT {_U}, 'All', count(*) FROM bids GROUP BY 1)"))
def _(v):
    return feed.city_tiles(user_bids(v))


_AMT = "CASE WHEN value = '' THEN NULL WHEN value LIKE '%k' THEN CAST(replace(replace(value, '$', ''), 'k', '') AS DOUBLE) * 1000 ELSE CAST(replace(value, '$', '') AS DOUBLE) END"


@register("a9_pipeline_stats", V.sql("bids", f"""SELECT user_id, all_n, none_n, won, lost, won_value, tracked_value, CASE WHEN won + lost > 0 THEN CAST(CAST(round_even(CAST(won AS DOUBLE) * 100 / (won + lost), 0) AS INTEGER) AS VARCHAR) || '%' ELSE '—' END AS win_rate FROM (
    SELECT {_U} AS user_id, count(*) AS all_n, count(*) FILTER (WHERE bid_id % 6 > 3) AS none_n, count(*) FILTER (WHERE bid_id % 6 = 1) AS won, count(*) FILTER (WHERE bid_id % 6 = 2) AS lost, coalesce(sum({_AMT}) FILTER (WHERE bid_id % 6 = 1), 0) AS won_value, coalesce(sum({_AMT}), 0) AS tracked_value FROM bids GROUP BY 1)"""))
def _(v):
    return feed.pipeline_stats(user_saved(v)).select("user_id", "all_n", "none_n", "won", "lost", "won_value", "tracked_value", "win_rate")


@register("f15_upcoming_filter", V.sql("bids", "SELECT bid_id FROM bids WHERE contains(lower(title || ' ' || scope || ' ' || town), 'kace')"))
def _(v):
    return feed.upcoming_filter(user_bids(v), "Kace").select("bid_id")


@register("w7_feed_sort_deadline", V.sql("bids", f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sort_key, bid_id) AS place FROM (SELECT bid_id, {_U} AS user_id, coalesce(CASE WHEN contains(deadline, 'ue') AND NOT contains(deadline, ', ') THEN NULL ELSE date_diff('day', DATE '2006-08-01', due_date) END, 9999) AS sort_key FROM bids)"))
def _(v):
    return feed.feed_sort(user_bids(v), "Deadline", V.as_of()).select("bid_id", "user_id", "sort_key", "place")


@register("w7_feed_sort_value", V.sql("bids", f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sort_key, bid_id) AS place FROM (SELECT bid_id, {_U} AS user_id, CASE WHEN bid_id % 10 = 0 THEN -5000 ELSE -coalesce({_AMT}, -1) END AS sort_key FROM bids)"))
def _(v):
    rows = feed.with_bid_key(user_bids(v)).withColumn("bid_key", F.concat("bid_key", F.col("bid_id").cast("string")))
    edits = rows.where("bid_id % 10 = 0").select("user_id", "bid_key", F.lit("$5k").alias("value"))
    return feed.feed_sort(rows, "Est. Value", V.as_of(), edits).select("bid_id", "user_id", "sort_key", "place")


@register("w8_open_first", V.sql("bids", f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY section, bid_id) AS place FROM (SELECT bid_id, {_U} AS user_id, CASE WHEN lower(status) = 'open' THEN 'open' ELSE 'other' END AS section FROM bids)"))
def _(v):
    return feed.open_first(user_bids(v)).select("bid_id", "user_id", "section", "place")


@register("j20_merge_saved", V.sql("bids", "SELECT bid_id, bid_id % 3 <> 0 AS pushed FROM bids"))
def _(v):
    rows = user_saved(v).withColumn("bid_key", F.col("bid_id").cast("string")).select("user_id", "bid_key", "bid_id")
    merged, push = feed.merge_saved(rows.where("bid_id % 3 = 0"), rows)
    return merged.join(push.select("bid_id", F.lit(True).alias("p")), "bid_id", "left").select("bid_id", F.coalesce("p", F.lit(False)).alias("pushed"))


@register("j21_saved_overrides", V.sql("bids", "SELECT bid_id, CASE WHEN bid_id % 10 = 0 THEN '$5k' ELSE value END AS value FROM bids"))
def _(v):
    rows = user_bids(v).withColumn("bid_key", F.col("bid_id").cast("string"))
    edits = rows.where("bid_id % 5 = 0").select("user_id", "bid_key", F.when(F.col("bid_id") % 10 == 0, F.lit("$5k")).otherwise(F.lit("")).alias("value"))
    return feed.saved_overrides(rows, edits, ["value"]).select("bid_id", "value")


@register("j22_merge_feed", V.sql("bids", f"""SELECT min(bid_id) AS bid_id FROM (SELECT *, {_U} AS user_id, substr(md5(town || title || scope), 1, 12) AS key FROM bids) b
    WHERE NOT EXISTS (SELECT 1 FROM bids h WHERE h.bid_id % 4 = 0 AND 'u' || CAST(h.bid_id % 30 AS VARCHAR) = b.user_id AND h.town = b.town AND substr(md5(h.town || h.title || h.scope), 1, 12) = b.key) GROUP BY b.user_id, b.town, b.key"""))
def _(v):
    rows = feed.with_bid_key(user_bids(v))
    return feed.merge_feed(rows.where("bid_id % 4 = 0"), rows, ["bid_key"])[1].select("bid_id")


# ---- accounts -----------------------------------------------------------------------
def billing(v):
    kind = (F.when(F.col("event_type") == "signup", F.lit(ledger.COMPLETED)).when(F.col("event_type") == "purchase", F.lit(ledger.PAID))
            .when(F.col("event_type") == "error", F.lit("customer.subscription.deleted")).otherwise(F.lit("other")))
    return v.table("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("cus"), F.col("user_id").cast("string")).alias("customer"),
        F.concat(F.lit("User"), (F.col("user_id") % 40).cast("string"), F.lit("@X.com")).alias("email"), F.concat(F.lit("d"), (F.col("user_id") % 60).cast("string")).alias("device"),
        (F.col("value") * 1000).cast("bigint").alias("amount_total"))


_BILL = """SELECT ts, event_id AS seq, event_type, 'cus' || user_id AS customer, 'user' || (user_id % 40) || '@x.com' AS email, 'd' || (user_id % 60) AS device, CASE WHEN CAST(trunc(value * 1000) AS BIGINT) >= 10000 THEN 'annual' ELSE 'monthly' END AS plan, user_id FROM events"""
_KNOWN = "SELECT customer, min(row(ts, seq)) AS f, arg_max(email, row(ts, seq)) AS email FROM bill WHERE event_type = 'signup' GROUP BY 1"
_ISSUED = "SELECT b.customer, s.email, row(b.ts, b.seq) AS moment FROM bill b JOIN known s ON s.customer = b.customer AND row(b.ts, b.seq) >= s.f WHERE event_type IN ('signup', 'purchase')"
_ENDED = """SELECT DISTINCT arg_max(i.customer, i.moment) AS customer, max(i.moment) AS moment FROM (SELECT s.email, row(b.ts, b.seq) AS moment FROM bill b JOIN known s ON s.customer = b.customer AND row(b.ts, b.seq) >= s.f WHERE event_type = 'error') e
    JOIN issued i ON i.email = e.email AND i.moment < e.moment GROUP BY e.email, e.moment"""
_PLAN = """SELECT d.customer, d.email, d.device, d.plan, i.ts AS issued_at, CAST(CAST(i.ts AS DATE) + CASE WHEN d.plan = 'annual' THEN 360 ELSE 30 END AS DATE) AS expires, e.customer IS NOT NULL AS revoked FROM
    (SELECT * FROM bill WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY customer ORDER BY ts DESC, seq DESC) = 1) d
    JOIN (SELECT customer, max(moment) AS moment, max(moment)[1] AS ts FROM issued GROUP BY 1) i USING (customer) LEFT JOIN ended e ON e.customer = i.customer AND e.moment = i.moment"""
_PL = dict(bill=_BILL, known=_KNOWN, issued=_ISSUED, ended=_ENDED, plans=_PLAN)


@register("a17_entitlements", V.sql("", "SELECT customer, email, device, plan, expires, revoked FROM plans", **_PL))
def _(v):
    return ledger.entitlements(billing(v)).select("customer", "email", "device", "plan", "expires", "revoked")


@register("a17_current_by_identity", V.sql("", "SELECT email, arg_max(customer, issued_at) AS customer FROM plans GROUP BY email", **_PL))
def _(v):
    return ledger.current_by_identity(ledger.entitlements(billing(v)), "email").select("email", "customer")


@register("a18_bonus_days", V.sql("", """SELECT g.email, CAST(sum(days) AS INTEGER) AS bonus_days, CAST(greatest(coalesce(any_value(p.expires), DATE '2024-02-01'), DATE '2024-02-01') + CAST(sum(days) AS INTEGER) AS DATE) AS expires FROM (
    SELECT unnest([referrer, referred]) AS email, unnest([30, 14]) AS days FROM (SELECT * FROM (SELECT ts, seq, email AS referred, 'user' || ((user_id * 7 + 3) % 40) || '@x.com' AS referrer FROM bill WHERE event_type = 'signup' AND user_id % 4 <> 0) WHERE referrer <> referred AND referrer IN (SELECT email FROM bill)
      QUALIFY row_number() OVER (PARTITION BY referred ORDER BY ts, seq) = 1)) g LEFT JOIN (SELECT email, arg_max(expires, issued_at) AS expires FROM plans GROUP BY email) p USING (email) GROUP BY g.email""", **_PL))
def _(v):
    b = billing(v)
    k = F.regexp_extract("customer", r"(\d+)", 1).cast("int")
    red = b.where(F.col("type") == ledger.COMPLETED).select("ts", "seq", F.col("email").alias("referred_email"), F.col("device").alias("referred_device"),
                                                            F.concat(F.when(k % 4 == 0, F.lit("bad")).otherwise(F.lit("c")), ((k * 7 + 3) % 40).cast("string")).alias("code"))
    codes = b.select((F.regexp_extract("email", r"(\d+)@", 1)).alias("n"), "email").distinct().select(F.concat(F.lit("c"), "n").alias("code"), "email")
    return ledger.bonus_days(red, codes, ledger.entitlements(b), V.events_as_of())


def trials(v):
    return v.table("events").where("event_type = 'signup'").groupBy(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("device")).agg(F.max(F.col("ts").cast("timestamp")).alias("started"))


@register("a19_account_summary", V.sql("", """SELECT (SELECT count(*) FROM tr WHERE TIMESTAMP '2024-02-01' <= s + INTERVAL 7 DAY) AS active_trials, (SELECT count(*) FROM tr) AS total_trials,
    (SELECT count(*) FROM plans WHERE NOT revoked) AS active_subs, (SELECT count(*) FROM plans) AS issued, (SELECT count(*) FROM plans WHERE revoked) AS revoked""", **_PL, tr="SELECT user_id, max(ts) AS s FROM events WHERE event_type = 'signup' GROUP BY 1"))
def _(v):
    return ledger.account_summary(ledger.entitlements(billing(v)), trials(v), V.events_as_of())


@register("a19_trial_list", "SELECT 'd' || user_id AS device, CAST(max(ts) AS DATE) + 7 AS expires, TIMESTAMP '2024-02-01' <= max(ts) + INTERVAL 7 DAY AS active FROM events WHERE event_type = 'signup' GROUP BY user_id")
def _(v):
    return ledger.trial_list(trials(v), V.events_as_of()).select("device", "expires", "active")


def reviews(v):
    k = F.col("s_suppkey")
    return v.table("supplier").select(
        k.alias("user_id"), ((k % 5) + 1).cast("int").alias("rating"), F.when(k % 6 == 5, F.lit(" ")).otherwise(F.concat(F.lit("Good "), k.cast("string"))).alias("quote"),
        F.col("s_name").alias("display_name"), F.lit("Co").alias("company"), (k % 3 != 0).alias("approved"),
        F.timestamp_seconds(F.lit(1_700_000_000) + k * 60).alias("created_at"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("updated_at"))


@register("j25_review_upsert", """SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 4 = 1 THEN 5 ELSE s_suppkey % 5 + 1 END AS rating, CASE WHEN s_suppkey % 4 = 1 AND s_suppkey % 5 + 1 <> 5 THEN FALSE ELSE s_suppkey % 3 <> 0 END AS approved FROM supplier
    UNION ALL SELECT 1000000 + s_suppkey, s_suppkey % 5 + 1, FALSE FROM supplier""")
def _(v):
    old = reviews(v)
    new = old.drop("approved", "created_at", "updated_at").withColumn("seq", F.col("user_id"))
    edits = new.where("user_id % 2 = 1").withColumn("rating", F.when(F.col("user_id") % 4 == 1, F.lit(5)).otherwise(F.col("rating")))
    added = new.withColumn("user_id", F.col("user_id") + 1_000_000)
    bad = new.withColumns({"rating": F.lit(9), "seq": F.col("seq") + 5})
    return ledger.review_upsert(old, edits.unionByName(added).unionByName(bad), V.as_of()).select("user_id", "rating", "approved")


@register("f18_published_reviews", "SELECT s_suppkey % 5 + 1 AS rating, 'Good ' || s_suppkey AS quote FROM (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY s_suppkey DESC LIMIT 6) WHERE s_suppkey % 6 <> 5")
def _(v):
    return ledger.published_reviews(reviews(v)).select("rating", "quote")


_MAIL = "SELECT doc_id AS seq, doc_id % 3 AS campaign, lower(e) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) AS e FROM documents UNION ALL SELECT o_orderkey, 'Buyer' || (o_orderkey % 700) || '@X.gov' FROM orders UNION ALL SELECT o_orderkey, 'not an address' FROM orders)"
_QUEUE = "SELECT campaign, email, min(seq) AS seq FROM mail WHERE contains(email, '@') AND NOT regexp_matches(email, '^buyer[0-9]*0@') GROUP BY campaign, email"


def _mail(v):
    from noticegrid.functions.posting import emails_in
    docs = v.table("documents").select(F.col("doc_id").alias("seq"), F.explode(emails_in("text")).alias("address"))
    k = F.col("o_orderkey")
    more = v.table("orders").select(k.alias("seq"), F.concat(F.lit(" Buyer"), (k % 700).cast("string"), F.lit("@X.gov")).alias("address"))
    junk = v.table("orders").select(k.alias("seq"), F.lit("not an address").alias("address"))
    return docs.unionByName(more).unionByName(junk).withColumn("campaign", F.col("seq") % 3)


def _suppressed(v):
    k = F.col("o_orderkey") % 700
    return v.table("orders").where(k % 10 == 0).select(F.concat(F.lit("BUYER"), k.cast("string"), F.lit("@x.gov ")).alias("email"))


@register("j26_suppress_recipients", V.sql("", "SELECT campaign, email, ord, CAST(ceil(ord / 200.0) AS BIGINT) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY seq, email) AS ord FROM queue)", mail=_MAIL, queue=_QUEUE))
def _(v):
    return ledger.clean_recipients(_mail(v), _suppressed(v)).select("campaign", "email", "ord", "batch")


@register("j26_recipients_report", V.sql("", "SELECT q.campaign, a.asked, a.asked - q.n AS suppressed, least(q.n, 200) AS queued, greatest(q.n - 200, 0) AS over_limit FROM (SELECT campaign, count(*) AS n FROM queue GROUP BY 1) q JOIN (SELECT campaign, count(DISTINCT email) AS asked FROM mail WHERE contains(email, '@') GROUP BY 1) a USING (campaign)", mail=_MAIL, queue=_QUEUE))
def _(v):
    return ledger.recipients_report(_mail(v), _suppressed(v))
