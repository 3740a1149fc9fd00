"""Column rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions import dates, keys, leads, money, places, posting, relevance, text, urls
from noticegrid.operators import bids as bid_ops
from noticegrid.workload import views as V
from noticegrid.workload.registry import register

NOW = f"TIMESTAMP '{V.AS_OF}'"


def rx(terms) -> str:
    return text.terms_pattern(terms).replace("'", "''")


_SHUT = f"regexp_matches(lower(status), '{rx(vocab.CLOSED_STATUS_WORDS)}')"
_STRONG = f"regexp_matches(lower(title), '\\bada\\b|{rx(vocab.STRONG_TERMS)}')"
RELEVANT_TITLE = _REL = f"({_STRONG} OR (regexp_matches(lower(title), '{rx(vocab.NICHE_TERMS)}') AND NOT regexp_matches(lower(title), '{rx(vocab.UNRELATED_TERMS)}')))"


def _rule(name, sql, **columns):
    """A rule applied to the bid view: columns are functions of nothing but its fields."""
    @register(name, sql)
    def _(v):
        return v.bids().select("bid_id", *[c().alias(n) for n, c in columns.items()])


_rule("c1_parse_deadline", V.sql("bids", "SELECT bid_id, due_date AS due FROM bids"), due=lambda: dates.parse_deadline("deadline"))
_rule("c2_deadline_moment", V.sql("bids", "SELECT bid_id, CASE WHEN contains(deadline, 'CST') THEN strftime(CAST(due_date AS TIMESTAMP) + INTERVAL 20 HOUR, '%Y-%m-%d %H:%M') END AS moment FROM bids"),
      moment=lambda: F.date_format(dates.deadline_moment("deadline"), "yyyy-MM-dd HH:mm"))
_rule("c3_deadline_status", V.sql("judged", "SELECT bid_id, status_now FROM judged"),
      status_now=lambda: dates.deadline_status("status", "deadline", V.as_of()))
_rule("c4_stale_year_status", V.sql("bids", f"SELECT bid_id, CASE WHEN deadline = '' AND NOT {_SHUT} AND contains(scope, '2004') THEN 'Closed' ELSE status END AS status_now FROM bids"),
      status_now=lambda: dates.stale_year_status("status", "deadline", "title", "scope", V.as_of()))
_rule("c5_clean_deadline", V.sql("bids", "SELECT bid_id, CASE WHEN deadline = 'in 8 days' THEN '' ELSE deadline END AS deadline FROM bids"),
      deadline=lambda: dates.clean_deadline("deadline"))
_rule("c6_age_out", V.sql("bids", f"SELECT bid_id, CASE WHEN NOT {_SHUT} AND due_date IS NULL AND CASE WHEN published <> '' THEN CAST(published AS DATE) ELSE DATE '2006-01-01' + CAST(bid_id % 300 AS INTEGER) END <= DATE '2006-06-02' THEN 'Closed' ELSE status END AS status_now FROM bids"),
      status_now=lambda: dates.age_out_status("status", "deadline", "published", F.date_add(F.lit("2006-01-01").cast("date"), (F.col("bid_id") % 300).cast("int")), V.as_of()))
_rule("c21_parse_value", V.sql("bids", """SELECT bid_id, CASE WHEN value = '' THEN -1.0 WHEN value LIKE '%k' THEN CAST(replace(replace(value, '$', ''), 'k', '') AS DOUBLE) * 1000 ELSE CAST(replace(value, '$', '') AS DOUBLE) END AS amount,
      CASE WHEN value LIKE '%k' AND CAST(replace(replace(value, '$', ''), 'k', '') AS DOUBLE) BETWEEN 1 AND 999 THEN value ELSE '-' END AS shown FROM bids"""),
      amount=lambda: money.parse_value("value"),
      shown=lambda: F.when(F.col("value").endswith("k") & money.parse_value("value").between(1000, 999000), money.format_money(money.parse_value("value"))).otherwise(F.lit("-")))
_rule("c22_days_until", V.sql("bids", "SELECT bid_id, CASE WHEN contains(deadline, 'ue') AND NOT contains(deadline, ', ') THEN NULL ELSE date_diff('day', DATE '2006-08-01', due_date) END AS days FROM bids"),
      days=lambda: dates.days_until("deadline", V.as_of()))
_rule("c23_bid_keys", V.sql("bids", "SELECT bid_id, substr(sha256(town || '|' || title || '|' || deadline || '|' || url), 1, 16) AS sig, substr(md5(town || title || scope), 1, 12) AS bid_key FROM bids"),
      sig=lambda: keys.bid_signature("town", "title", "deadline", "url"), bid_key=lambda: keys.bid_id("town", "title", "scope"))
_rule("c29_label_for", V.sql("bids", "SELECT bid_id, CASE WHEN town_state = 'TX' THEN town ELSE town || ', ' || town_state END AS label FROM bids"),
      label=lambda: places.label_for("town", "town_state", F.lit("TX")))
_rule("f1_looks_relevant", V.sql("bids", f"SELECT bid_id, {_REL} AS relevant FROM bids"), relevant=lambda: relevance.looks_relevant("title"))
_rule("f2_rejection_reason", V.sql("bids", "SELECT bid_id, CASE " + " ".join(f"WHEN contains(lower(title), '{t}') THEN 'unrelated:{t}'" for t in vocab.UNRELATED_TERMS) + " ELSE 'no_niche_keyword' END AS reason FROM bids"),
      reason=lambda: relevance.rejection_reason("title"))
_rule("f3_is_construction", V.sql("bids", f"SELECT bid_id, regexp_matches(lower(title), '{rx(vocab.CONSTRUCTION_TERMS)}') AS construction FROM bids"), construction=lambda: relevance.is_construction("title"))
_rule("f4_is_open", V.sql("bids", f"SELECT bid_id, NOT {_SHUT} AS open FROM bids"), open=lambda: relevance.is_open("status"))
_NEWS = "(CASE bid_id % 4 WHEN 0 THEN 'Council awarded the job. ' WHEN 1 THEN 'Notice of award: ' WHEN 2 THEN 'Accepting bids, the last one has been awarded ' ELSE '' END || title || CASE WHEN bid_id % 7 = 0 THEN ' Bid opening Friday' ELSE '' END)"
_rule("f5_looks_awarded", V.sql("bids", "SELECT bid_id, bid_id % 4 IN (0, 1) AND bid_id % 7 <> 0 AS awarded FROM bids"),
      awarded=lambda: relevance.looks_awarded(F.expr(_NEWS)))
_rule("f14_feed_filter", V.sql("bids", f"SELECT bid_id, contains(lower(title || ' ' || scope), 'plan') AS by_word, regexp_matches(lower(title || ' ' || scope), '{rx(vocab.TRADE_KEYWORDS['Roads / Sitework'])}') AS by_trade, lower(town) = 'kaba' AS by_city FROM bids"),
      by_word=lambda: relevance.matches_feed("title", "scope", "town", keyword=" Plan "),
      by_trade=lambda: relevance.matches_feed("title", "scope", "town", trade="Roads / Sitework"),
      by_city=lambda: relevance.matches_feed("title", "scope", "town", in_city="KABA"))
_rule("w1_fit_score", V.sql("bids", f"""SELECT bid_id, CASE WHEN {_SHUT} THEN -100 WHEN due_date IS NULL THEN 0 WHEN due_date < DATE '2006-08-01' THEN -50 ELSE greatest(0, 30 - least(date_diff('day', DATE '2006-08-01', due_date), 30)) END
      + 2 * (SELECT count(*) FROM (VALUES ('sidewalk'), ('ada ramp'), ('ada'), ('curb'), ('gutter'), ('concrete'), ('flatwork')) w(k) WHERE contains(lower(title || ' ' || scope), k))
      + CASE WHEN email <> '' OR phone <> '' THEN 3 ELSE 0 END + CASE WHEN value <> '' THEN 1 ELSE 0 END AS score FROM bids"""),
      score=lambda: relevance.fit_score("status", dates.parse_deadline("deadline"), "title", "scope", "email", "phone", "value", V.as_of()))
_rule("p7_split_city_state", V.sql("bids", "SELECT bid_id, trim(split_part(city, ',', 1)) AS place, trim(split_part(city, ',', 2)) AS st FROM bids"),
      place=lambda: places.split_city_state("city")["city"], st=lambda: places.split_city_state("city")["state"])
_rule("p9_normalize_place", V.sql("bids", "SELECT bid_id, CASE WHEN bid_id % 20 = 2 THEN substr(city, 9) WHEN bid_id % 3 = 0 THEN city ELSE city END AS place FROM bids"),
      place=lambda: places.normalize_place(F.when((F.col("bid_id") % 3 == 0) & (F.col("city") != ""), F.concat("city", F.lit(" School District, "))).otherwise(F.col("city"))))
_rule("p10_clean_city_label", V.sql("bids", "SELECT bid_id, town AS label FROM bids"),
      label=lambda: places.clean_city_label(F.concat("town", F.lit(", "), F.when(F.col("bid_id") % 2 == 0, F.col("town_state")).otherwise(
          F.initcap(F.try_element_at(F.create_map(*[F.lit(x) for kv in vocab.STATE_NAMES.items() for x in kv]), F.col("town_state"))))), "town_state"))
_rule("p11_entity_type", V.sql("bids", "SELECT bid_id, CASE WHEN city LIKE '% County' THEN 'County' ELSE 'City' END AS kind FROM bids"), kind=lambda: places.entity_type("city"))
_rule("f10_name_classes", V.sql("bids", "SELECT bid_id, city LIKE '% County' AS authority, city LIKE '% County' AS county, bid_id % 4 = 0 AS non_place FROM bids"),
      authority=lambda: places.looks_like_authority("city"), county=lambda: places.county_shaped("city"), non_place=lambda: places.is_non_place(F.expr("CASE bid_id % 4 WHEN 0 THEN city || ' Township' ELSE city END")))
_rule("c19_resolve_url", V.sql("bids", "SELECT bid_id, CASE bid_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://page.gov/list' WHEN 2 THEN 'https://page.gov/b/' || bid_id ELSE 'https://page.gov/list' END AS link FROM bids"),
      link=lambda: urls.resolve_url(F.expr("CASE bid_id % 4 WHEN 0 THEN url WHEN 1 THEN '' WHEN 2 THEN '/b/' || bid_id ELSE 'https://made.up/' || bid_id END"),
                                    F.lit("https://page.gov/list"), F.concat(F.lit("Printed: "), F.col("url"))))


@register("p8_normalize_state", V.sql("towns", "SELECT town_id, CASE town_id % 4 WHEN 3 THEN '' ELSE state END AS code FROM towns"))
def _(v):
    names = F.create_map(*[F.lit(x) for kv in vocab.STATE_NAMES.items() for x in kv])
    k = F.col("town_id") % 4
    raw = (F.when(k == 0, F.col("state")).when(k == 1, F.initcap(F.try_element_at(names, F.col("state"))))
           .when(k == 2, F.concat(F.lit(" "), F.lower("state"))).otherwise(F.concat(F.col("state"), F.lit("x"))))
    return v.towns().select("town_id", places.state_code(raw).alias("code"))


_PAGES = [("f7_is_aggregator_url", "regexp_matches(host, '(^|\\.)(' || '{}' || ')$')".format(rx([*vocab.AGGREGATOR_DOMAINS, "example.net"])),
           lambda: urls.is_aggregator_url("url", [*vocab.AGGREGATOR_DOMAINS, "example.net"])),
          ("f9_is_gov_domain", "host LIKE '%.gov'", lambda: urls.is_gov_domain(urls.host_of("url"))),
          ("f20_junk_host", f"regexp_matches(host, '{rx(vocab.JUNK_HOST_PARTS)}')", lambda: urls.is_junk_host(urls.full_host("url")))]
_LINKS = "SELECT url, regexp_replace(lower(regexp_extract(url, '//([^/:?#]+)', 1)), '^www\\.', '') AS host FROM (SELECT url FROM pages UNION ALL SELECT url FROM portals)"


def _links(v):
    return v.table("pages").select("url").unionByName(v.portals().select("url"))


for _name, _sql, _fn in _PAGES:
    register(_name, V.sql("portals", f"SELECT url, {_sql} AS flag FROM links", links=_LINKS))(lambda v, fn=_fn: _links(v).select("url", fn().alias("flag")))


@register("f8_identify_platform", V.sql("portals", "SELECT url, CASE WHEN regexp_matches(lower(url), '/bids\\.aspx') THEN 'civicplus' WHEN host LIKE '%.gov' AND contains(url, 'purchasing') THEN 'agency' ELSE '' END AS platform FROM links", links=_LINKS))
def _(v):
    return _links(v).select("url", urls.identify_platform("url").alias("platform"))


@register("c20_host_and_join", V.sql("portals", """SELECT url, host, regexp_extract(url, '^(https?://[^/]+)', 1) || '/up/x?y=1' AS rooted,
    regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || 'rel.html' AS relative FROM links""", links=_LINKS))
def _(v):
    return _links(v).select("url", urls.host_of("url").alias("host"), urls.url_join("url", F.lit("/a/../up/./x?y=1")).alias("rooted"),
                            urls.url_join("url", F.lit("rel.html")).alias("relative"))


@register("c9_html_to_text", """SELECT page_id, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)""")
def _(v):
    return v.table("pages").select("page_id", F.md5(text.html_to_text("html")).alias("digest"))


@register("c10_clean_unescape", """SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '),
    '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages""")
def _(v):
    return v.table("pages").select("page_id", F.md5(text.visible("html")).alias("digest"))


@register("c11_slug", "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS digest FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.md5(text.slug("text")).alias("digest"))


@register("c14_contact_fields", """SELECT doc_id, CASE WHEN p = '' THEN '' ELSE '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) END AS phone,
    coalesce(list_filter(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}'), lambda e: NOT regexp_matches(lower(e), 'webmaster|postmaster|no\\-reply|noreply|donotreply|example\\.com|sentry\\.io|@2x|civicplus\\.com'))[1], '') AS email
    FROM (SELECT doc_id, text, p, right(regexp_replace(p, '[^0-9]', '', 'g'), 10) AS d FROM (SELECT doc_id, text, regexp_extract(text, '(?:^|[^0-9\\-])((?:\\+?1[\\s.\\-]*)?\\(?[2-9][0-9]{2}\\)?[\\s.\\-]*[0-9]{3}[\\s.\\-]*[0-9]{4})(?:$|[^0-9\\-])', 1) AS p FROM documents))""")
def _(v):
    return v.table("documents").select("doc_id", posting.contact_phone("text").alias("phone"), posting.contact_email("text").alias("email"))


@register("c28_page_title", """SELECT page_id, left(trim(regexp_extract(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^([^|–—]*)', 1)), 120) AS title FROM pages""")
def _(v):
    return v.table("pages").select("page_id", posting.page_title("html").alias("title"))


@register("c24_classify_lead", V.sql("leads", "SELECT permit_id, CASE WHEN contractor_trade = '' THEN 'open' ELSE lead_type END AS lead_type FROM leads"))
def _(v):
    return v.leads().select("permit_id", leads.classify_lead("contractor_trade", "contractor_name").alias("lead_type"))


@register("c25_candidate_urls", V.sql("crawl", "SELECT domain, CAST(i AS INTEGER) - 1 AS rank, 'https://' || domain || p[i] AS url FROM (SELECT domain, list_value(" + ", ".join(f"'{p}'" for p in vocab.CANDIDATE_PATHS) + f") AS p FROM crawl), range(1, {len(vocab.CANDIDATE_PATHS) + 1}) r(i)"))
def _(v):
    return v.crawl().select("domain", F.explode(urls.candidate_urls("domain")).alias("c")).select("domain", "c.rank", "c.url")


@register("c30_trial_state", f"""SELECT event_id, CASE WHEN TIMESTAMP '{V.EVENTS_AS_OF}' <= ts + INTERVAL 7 DAY THEN greatest(1, CAST(floor((epoch_us(ts + INTERVAL 7 DAY) - epoch_us(TIMESTAMP '{V.EVENTS_AS_OF}')) / 86400000000) AS INTEGER) + 1) ELSE 0 END AS days_left FROM events""")
def _(v):
    return v.table("events").select("event_id", dates.trial_days_left("ts", V.events_as_of()).alias("days_left"))


@register("f6_page_declares_closed", V.sql("bids", "SELECT bid_id, bid_id % 3 = 0 AND bid_id % 2 = 0 AS closed FROM bids"))
def _(v):
    body = F.concat(F.col("title"), F.when(F.col("bid_id") % 2 == 0, F.lit(" Status: Closed")).otherwise(F.lit(" Status: Open")))
    return v.bids().select("bid_id", relevance.declares_closed(body, (F.col("bid_id") % 3) + 1).alias("closed"))


@register("f11_is_county", V.sql("registry", "SELECT domain, type = 'County' OR org LIKE '% County' AS county FROM registry"))
def _(v):
    return v.registry().select("domain", places.is_county("type", "org").alias("county"))


@register("a1_dedupe_bids", V.sql("bids", "SELECT bid_id FROM (SELECT *, row_number() OVER (PARTITION BY town, lower(title), lower(deadline), CASE WHEN title = '' THEN bid_id ELSE -1 END ORDER BY seq) AS rn FROM bids) WHERE rn = 1"))
def _(v):
    return bid_ops.dedupe_bids(v.bids(), ["town"], ["seq", "url"], "bid_id").select("bid_id")


@register("w2_rank_within_city", V.sql("bids", "SELECT bid_id, row_number() OVER (PARTITION BY town_state ORDER BY length(title) DESC, seq) AS rank FROM bids"))
def _(v):
    from noticegrid.operators.common import rank_all
    score = -F.length("title")
    return rank_all(v.bids().select("bid_id", "seq", "title", "town_state"), ["town_state"], [score, F.floor(F.col("seq") / 65536)], [score, F.col("seq")]).select("bid_id", "rank")


_TODO = "SELECT bid_id % 40 AS search_id, bid_id, row_number() OVER (PARTITION BY bid_id % 40 ORDER BY CASE WHEN deadline = '' THEN 0 ELSE 1 END, seq) AS read_order FROM bids WHERE email = '' AND phone = ''"


@register("w5_enrich_budget", V.sql("bids", f"SELECT search_id, bid_id FROM ({_TODO}) WHERE read_order <= 14"))
def _(v):
    return bid_ops.enrich_budget(v.bids().withColumn("search_id", F.col("bid_id") % 40), 14).select("search_id", "bid_id")


@register("w5_read_order", V.sql("bids", _TODO))
def _(v):
    return bid_ops.enrich_budget(v.bids().withColumn("search_id", F.col("bid_id") % 40)).select("search_id", "bid_id", "read_order")


@register("p4_federal_to_bids", V.sql("bids", """SELECT lpad(CAST(bid_id AS VARCHAR), 9, 'a') AS notice, CASE WHEN title = '' THEN 'Untitled Opportunity' ELSE title END AS title, 'Federal · Solicitation' || CASE WHEN bid_id % 2 = 0 THEN ' · Dept of Roads' ELSE '' END AS scope,
    CASE WHEN bid_id % 3 = 0 THEN 'Closed' WHEN strftime(order_day + INTERVAL 8 YEAR, '%Y-%m-%d') < '2006-08-01' THEN 'Closed' ELSE 'Open' END AS status, strftime(order_day + INTERVAL 8 YEAR, '%Y-%m-%d') AS deadline,
    CASE WHEN bid_id % 5 = 0 THEN '' ELSE 'Ann Officer' END AS contact, CASE WHEN bid_id % 4 = 0 THEN 'https://fed.gov/' || bid_id ELSE 'https://sam.gov/opp/' || lpad(CAST(bid_id AS VARCHAR), 9, 'a') || '/view' END AS url, town AS city, town_state AS default_state FROM bids"""))
def _(v):
    b = v.table("orders").select(F.col("o_orderkey").alias("bid_id"), F.date_format(F.add_months("o_orderdate", 96), "yyyy-MM-dd").alias("day")).join(v.bids(), "bid_id")
    k = F.col("bid_id")
    fed = b.select(
        "title", F.lit("Solicitation").alias("type"), F.when(k % 3 == 0, F.lit("No")).otherwise(F.lit("Yes")).alias("active"),
        F.concat(F.col("day"), F.lit("T14:00:00-05:00")).alias("responseDeadLine"), F.when(k % 2 == 0, F.lit("Dept of Roads")).alias("fullParentPathName"),
        F.lit("").alias("organizationName"), F.when(k % 4 == 0, F.concat(F.lit("https://fed.gov/"), k.cast("string"))).alias("uiLink"),
        F.lpad(k.cast("string"), 9, "a").alias("noticeId"),
        F.when(k % 5 != 0, F.array(F.struct(F.lit("Ann Officer").alias("fullName"), F.lit("a@b.mil").alias("email"), F.lit("1").alias("phone")))).alias("pointOfContact"),
        F.struct(F.struct(F.col("town").alias("name")).alias("city"), F.struct(F.lower("town_state").alias("code")).alias("state")).alias("placeOfPerformance"))
    return bid_ops.federal_to_bids(fed, V.as_of()).select(F.col("noticeId").alias("notice"), "title", "scope", "status", "deadline", "contact", "url", "city", "default_state")


_NOTICE_SQL = "SELECT bid_id, title, town AS city, town_state AS state, bid_id % 3 = 0 AS approved FROM bids WHERE title <> '' AND bid_id % 8 <> 7"


def _notices(v):
    raw = v.bids().select("bid_id", F.concat(F.lit(" "), F.col("title")).alias("title"), "scope", F.col("town").alias("city"),
                          F.when(F.col("bid_id") % 8 == 7, F.lit("Atlantis")).otherwise(F.lower("town_state")).alias("state"), "deadline", "contact", "email", "phone", "url",
                          F.col("town").alias("agency"), (F.col("bid_id") % 3 == 0).alias("approved"), F.col("fallback_lat").alias("lat"), F.col("fallback_lon").alias("lon"))
    return bid_ops.agency_notices(raw)


@register("p6_agency_notices", V.sql("bids", _NOTICE_SQL))
def _(v):
    return _notices(v).select("bid_id", "title", "city", "state", "approved")


@register("p5_normalize_opportunities", V.sql("bids", f"""SELECT 'portals' AS source, 0 AS source_priority, bid_id, title, city, NULL AS agency FROM bids UNION ALL
    SELECT 'agency_posted', 1, n.bid_id, n.title, n.city, b.town FROM ({_NOTICE_SQL}) n JOIN bids b USING (bid_id) WHERE n.approved AND n.bid_id % 20 <> 8"""))
def _(v):
    rows = bid_ops.normalize_opportunities([("portals", v.bids()), ("agency_posted", bid_ops.approved_notices(_notices(v)))])
    return rows.select("source", "source_priority", "bid_id", "title", "city", "agency")


@register("u1_union_sources", V.sql("bids", f"SELECT bid_id, source FROM (SELECT bid_id, 'portals' AS source FROM bids UNION ALL SELECT bid_id, 'agency_posted' FROM ({_NOTICE_SQL}))"))
def _(v):
    return bid_ops.normalize_opportunities([("portals", v.bids()), ("agency_posted", _notices(v))]).select("bid_id", "source")


@register("u4_precision_guard", V.sql("bids", f"SELECT title FROM bids WHERE {_REL} INTERSECT SELECT title FROM bids WHERE contains(lower(title), 'landscap')"))
def _(v):
    b = v.bids()
    kept = b.where(relevance.looks_relevant("title")).select("title")
    return kept.intersect(b.where(text.has_any(F.lower("title"), ["landscap"])).select("title"))


@register("w10_rolling_history", "SELECT location, event_id, recency FROM (SELECT 'a' || CAST(user_id AS VARCHAR) AS location, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events) WHERE recency <= 25")
def _(v):
    scans = v.table("events").select(F.col("ts").alias("at"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("location"), F.lit(25).alias("radius"),
                                     F.col("event_id").alias("kept"), F.lit(0).alias("raw_local"), F.lit(0).alias("anchor_towns"),
                                     F.create_map(F.lit("kept"), F.lit(1)).alias("funnel"), F.col("event_id").alias("scan_id"))
    return bid_ops.rolling_history(scans, 25).select("location", F.col("kept").alias("event_id"), "recency")

