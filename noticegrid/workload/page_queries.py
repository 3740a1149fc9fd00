"""Page corpora: links, postings, feeds, details, page tests, contacts, page jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions import dates, posting, text, urls
from noticegrid.operators import bids as bid_ops
from noticegrid.operators import pages as P
from noticegrid.plans import discovery
from noticegrid.workload import views as V
from noticegrid.workload.registry import register
from noticegrid.workload.rule_queries import rx

HINTS = ("th", "en", "de", "que")
_ANCH = """SELECT page_id, url, pos, h[pos] AS href, trim(regexp_replace(regexp_replace(l[pos], '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM (
    SELECT page_id, url, regexp_extract_all(html, '<a[^>]+href="([^"#][^"]*)"[^>]*>(.*?)</a>', 1, 'is') AS h, regexp_extract_all(html, '<a[^>]+href="([^"#][^"]*)"[^>]*>(.*?)</a>', 2, 'is') AS l FROM pages) p, range(1, 200) r(pos) WHERE pos <= len(h)"""
_POST = f"""SELECT o_orderkey // 8 AS page_id, o_orderkey AS k, {V.sql_pick(V.TRADES, 'o_orderkey % 12')} || ' job ' || o_orderkey AS raw_title, 'https://t' || (o_orderkey // 8) || '.gov/bids.aspx?bidID=' || o_orderkey AS url,
    CASE WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate + INTERVAL 8 YEAR, '%-m/%-d/%Y') ELSE '' END AS deadline, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' ELSE 'Awarded' END AS status,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate + INTERVAL 8 YEAR AS DATE) END AS due FROM orders"""
_REL = f"(regexp_matches(lower(title), '\\bada\\b|{rx(vocab.STRONG_TERMS)}') OR (regexp_matches(lower(title), '{rx(vocab.NICHE_TERMS)}') AND NOT regexp_matches(lower(title), '{rx(vocab.UNRELATED_TERMS)}')))"
_POSTED = "SELECT page_id, trim(raw_title) AS title, url, deadline, status, due, k FROM posts"


@register("w15_link_candidates", V.sql("", """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY hits DESC, pos) AS INTEGER) AS rank, link, hits FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS rn FROM (SELECT page_id, pos, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS link,
      CAST(contains(b, 'th') AS INTEGER) + CAST(contains(b, 'en') AS INTEGER) + CAST(contains(b, 'de') AS INTEGER) + CAST(contains(b, 'que') AS INTEGER) AS hits FROM (SELECT *, lower(href || ' ' || label) AS b FROM anch) WHERE NOT regexp_matches(b, 'facebook\\.com')) WHERE hits > 0)
    WHERE rn = 1 QUALIFY rank <= 3""", anch=_ANCH))
def _(v):
    return P.link_candidates(v.table("pages"), k=3, hints=HINTS, noise=("facebook.com",))


@register("j18_link_for_title", V.sql("", """SELECT page_id, title, arg_min(regexp_extract(url, '^(https?://[^/]+)', 1) || href, (length(slug), pos)) AS link FROM (
    SELECT t.page_id, t.title, a.url, a.href, a.pos, regexp_replace(lower(a.label), '[^a-z0-9]', '', 'g') AS slug, regexp_replace(lower(t.title), '[^a-z0-9]', '', 'g') AS want
    FROM (SELECT DISTINCT page_id, label || ' public' AS title FROM anch WHERE pos % 2 = 0) t JOIN anch a ON a.page_id = t.page_id)
    WHERE length(want) >= 6 AND slug <> '' AND NOT regexp_matches(lower(href), 'x\\.com') AND (contains(slug, want) OR (length(slug) >= 6 AND contains(want, slug))) GROUP BY page_id, title""", anch=_ANCH))
def _(v):
    pages = v.table("pages").select("page_id", "url", "html")
    titles = P.anchors(pages).where("pos % 2 = 1").select("page_id", F.concat("label", F.lit(" public")).alias("title")).distinct()
    return P.link_for_title(pages, titles, min_len=6)


@register("w16_posting_segments", V.sql("", "SELECT page_id, title, url, deadline, status FROM posted", posts=_POST, posted=_POSTED))
def _(v):
    return P.posting_rows(v.listing_pages()).select("page_id", "title", "url", "deadline", "status")


@register("b5_postings_from_pages", V.sql("", f"SELECT page_id, title, url, deadline, status FROM posted WHERE {_REL}", posts=_POST, posted=_POSTED))
def _(v):
    return P.postings_from_pages(v.listing_pages()).select("page_id", "title", "url", "deadline", "status")


@register("b10_recall", V.sql("", "SELECT expected, found, avg(CAST(found AS INTEGER)) OVER () AS recall FROM (SELECT expected, lower(expected) IN (SELECT w FROM hit) AS found FROM expected)",
    posts=_POST, posted=_POSTED, expected="SELECT 'Sidewalk REPLACEMENT job ' || o_orderkey AS expected FROM orders WHERE o_orderkey % 8 < 3",
    hit=f"SELECT DISTINCT w FROM (SELECT DISTINCT lower(expected) AS w FROM expected) JOIN (SELECT DISTINCT lower(title) AS t FROM posted WHERE {_REL}) ON contains(t, w)"))
def _(v):
    k = F.col("o_orderkey")
    expected = v.table("orders").where(k % 8 < 3).select(F.concat(F.lit("Sidewalk REPLACEMENT job "), k.cast("string")).alias("expected"))
    return P.recall(P.postings_from_pages(v.listing_pages()), expected)


@register("j30_recall_join", V.sql("bids", "SELECT expected, lower(expected) IN (SELECT w FROM hit) AS found FROM expected",
    expected="SELECT CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_name WHEN 2 THEN substr(p_type, 1, 4) ELSE 'Sidewalk replacement ' || p_name || ' zeppelin' END AS expected FROM part",
    hit="SELECT DISTINCT w FROM (SELECT DISTINCT lower(expected) AS w FROM expected) JOIN (SELECT DISTINCT lower(title) AS t FROM bids) ON contains(t, w)"))
def _(v):
    kind, name, type_ = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_type")
    expected = v.table("part").select(F.when(kind == 0, F.lower(type_)).when(kind == 1, name).when(kind == 2, F.substring(type_, 1, 4))
                                      .otherwise(F.concat(F.lit("Sidewalk replacement "), name, F.lit(" zeppelin"))).alias("expected"))
    return P.recall(v.bids(), expected).select("expected", "found")


@register("a2_page_outcomes", V.sql("", f"""SELECT 'postings' AS reason, count(DISTINCT o_orderkey // 8) AS n FROM orders UNION ALL SELECT CASE WHEN regexp_matches(lower(t), '\\bada\\b|{rx(vocab.STRONG_TERMS)}') OR (regexp_matches(lower(t), '{rx(vocab.NICHE_TERMS)}') AND NOT regexp_matches(lower(t), '{rx(vocab.UNRELATED_TERMS)}')) THEN 'for_extraction' ELSE 'portal_no_niche_content' END, count(*)
    FROM (SELECT regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g') AS t FROM pages) GROUP BY 1"""))
def _(v):
    return P.page_outcomes(v.listing_pages().unionByName(v.table("pages").select("page_id", "url", "html")))


@register("f13_page_is_empty", "SELECT o_orderkey // 8 AS page_id, FALSE AS empty FROM orders GROUP BY 1 UNION ALL SELECT -1 - page_id, contains(lower(html), 'bids.aspx') OR contains(lower(html), 'bid postings') OR page_id % 2 = 0 FROM pages")
def _(v):
    tail = F.when(F.col("page_id") % 2 == 0, F.lit("<h1>Bid Postings</h1>")).otherwise(F.lit(""))
    other = v.table("pages").select((-1 - F.col("page_id")).alias("page_id"), "url", F.concat("html", tail).alias("html"))
    rows = v.listing_pages().unionByName(other)
    return rows.select("page_id", P.page_is_empty("html").alias("empty"))


_FEED = "SELECT k // 8 AS feed_id, k % 8 AS pos, title, 'https://f.gov/' || k AS url, deadline, status FROM posted WHERE (k // 8) % 10 <> 0"


@register("s8_feed_items", V.sql("", "SELECT feed_id, pos, title, url, deadline, status FROM feed", posts=_POST, posted=_POSTED, feed=_FEED))
def _(v):
    rows = P.posting_rows(v.listing_pages()).withColumn("k", F.regexp_extract("url", r"bidID=(\d+)", 1).cast("bigint"))
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>https://f.gov/"), F.col("k").cast("string"), F.lit("</link><description>Status: "), "status",
                    F.lit(" &lt;b&gt;Closes:&lt;/b&gt; "), "deadline", F.lit("</description></item>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("i")))), lambda x: x["i"]), "")
    feeds = rows.groupBy(F.floor(F.col("k") / 8).alias("feed_id")).agg(body.alias("_b")).select(
        "feed_id", F.concat(F.lit("<rss><channel><title>Bids</title>"), "_b", F.when(F.col("feed_id") % 10 == 0, F.lit("<item></channel>")).otherwise(F.lit("</channel></rss>"))).alias("xml"))
    return P.feed_items(feeds).select("feed_id", "pos", "title", "url", "deadline", "status")


@register("s9_bid_feed_link", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN rtrim(url, '/') || '/RSSFeed.aspx?ModID=' || page_id ELSE 'https://other.gov/rss.aspx?x=bid' END AS feed FROM pages WHERE page_id % 5 <> 0")
def _(v):
    k = F.col("page_id")
    index = F.concat("html", F.lit('<a href="/rss.aspx?ModID=1">News</a>'),
                     F.when(k % 5 == 0, F.lit("")).when(k % 2 == 0, F.concat(F.lit('<a class="b" href="/RSSFeed.aspx?ModID='), k.cast("string"), F.lit('">Bid Postings</a>')))
                     .otherwise(F.lit('<a href="https://other.gov/rss.aspx?x=bid">All</a>')), F.lit('<a href="/rss.aspx?late">Bids too</a>'))
    pages = v.table("pages").select("page_id", "url", F.when(k % 5 == 0, F.lit('<a href="/rss.aspx">News</a>')).otherwise(index).alias("html"))
    return P.bid_feed_link(pages)


@register("s10_extraction_rows", V.sql("bids", "SELECT bid_id // 8 AS doc, bid_id % 8 AS pos, title, CASE WHEN deadline = 'in 8 days' THEN '' ELSE deadline END AS deadline, url FROM bids WHERE (bid_id // 8) % 7 <> 0"))
def _(v):
    obj = F.to_json(F.struct("title", "deadline", "url", "city"))
    out = v.bids().groupBy(F.floor(F.col("bid_id") / 8).alias("doc")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bid_id", obj.alias("o")))), lambda x: x["o"]), ", ").alias("_b"))
    text_out = out.select("doc", F.when(F.col("doc") % 7 == 0, F.lit("No bids here, sorry.")).otherwise(
        F.concat(F.lit("Here you are:\n["), "_b", F.lit("]\nDone."))).alias("output"))
    return P.extraction_rows(text_out).select("doc", "pos", "title", "deadline", "url")


@register("f6_page_verdicts", V.sql("bids", "SELECT bid_id, CASE WHEN bid_id % 5 = 0 THEN 'Closed' ELSE status END AS status FROM bids"))
def _(v):
    rows = v.bids().select("bid_id", F.col("bid_id").alias("page_id"), "status")
    texts = v.bids().select(F.col("bid_id").alias("page_id"), F.when(F.col("bid_id") % 5 == 0, F.lit("This solicitation is closed")).otherwise(F.lit("Bids due soon")).alias("page_text"))
    return P.with_page_verdicts(rows, texts).select("bid_id", "status")


@register("b12_details_from_pages", """SELECT url, CASE WHEN k % 2 = 0 THEN 'Marla Whitfield' ELSE '' END AS contact, CASE WHEN k % 3 = 0 THEN 'clerk' || k || '@town.gov' ELSE '' END AS email,
    CASE WHEN k % 5 = 0 THEN '(417) 864-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') ELSE '' END AS phone, CASE WHEN k % 4 = 1 THEN day ELSE '' END AS deadline,
    CASE WHEN k % 7 = 2 AND length(price) >= 4 THEN '$' || price ELSE '' END AS value, CASE WHEN k % 3 = 1 THEN day ELSE '' END AS published, CASE WHEN k % 3 = 2 THEN 'A-' || k ELSE '' END AS bid_number,
    CASE k % 6 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'yes' ELSE '' END AS prebid, k % 9 = 4 AS addenda, CASE WHEN k % 4 = 0 THEN 'https://d.gov/DocumentCenter/View/' || k || ';https://d.gov/bids/plan.pdf' ELSE '' END AS docs,
    'Replace and repair the public way along Main Street, phase ' || k AS scope
    FROM (SELECT o_orderkey AS k, 'https://d.gov/bids/' || o_orderkey AS url, strftime(o_orderdate + INTERVAL 8 YEAR, '%-m/%-d/%Y') AS day, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM orders)""")
def _(v):
    d = bid_ops.details_from_pages(v.detail_pages())
    return d.select("url", "contact", "email", "phone", "deadline", "value", "published", "bid_number", "prebid", "addenda",
                    F.array_join("documents", ";").alias("docs"), F.regexp_extract("scope", r"^(.*phase \d+)", 1).alias("scope"))


_DETAIL = {"c12_close_date": ("CASE WHEN k % 4 = 1 THEN day ELSE '' END", lambda t: dates.close_date(t)), "c15_detail_value": ("CASE WHEN k % 7 = 2 AND length(price) >= 4 THEN '$' || price ELSE '' END", lambda t: posting.detail_value(t)),
           "c16_detail_fields": ("CASE WHEN k % 3 = 1 THEN day ELSE '' END || '|' || CASE WHEN k % 3 = 2 THEN 'A-' || k ELSE '' END || '|' || CASE k % 6 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'yes' ELSE '' END || '|' || CAST(k % 9 = 4 AS VARCHAR)",
                                 lambda t: F.concat_ws("|", posting.detail_published(t), posting.detail_bid_number(t), posting.detail_prebid(t), posting.detail_addenda(t).cast("string"))),
           "c18_detail_scope": ("'Replace and repair the public way along Main Street, phase ' || k", lambda t: F.regexp_extract(posting.detail_scope(t), r"^(.*phase \d+)", 1))}
for _name, (_sql, _fn) in _DETAIL.items():
    register(_name, f"SELECT k AS bid_id, {_sql} AS found FROM (SELECT o_orderkey AS k, strftime(o_orderdate + INTERVAL 8 YEAR, '%-m/%-d/%Y') AS day, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM orders)")(
        lambda v, fn=_fn: v.detail_pages().select("bid_id", text.visible("html").alias("t")).select("bid_id", fn("t").alias("found")))


@register("c13_status_near", V.sql("", "SELECT k AS bid_id, status FROM posted", posts=_POST, posted=_POSTED))
def _(v):
    rows = P.posting_rows(v.listing_pages())
    return rows.select(F.regexp_extract("url", r"bidID=(\d+)", 1).cast("bigint").alias("bid_id"), "status")


@register("c17_detail_documents", "SELECT o_orderkey AS bid_id, CASE WHEN o_orderkey % 4 = 0 THEN 'https://d.gov/DocumentCenter/View/' || o_orderkey || ';https://d.gov/bids/plan.pdf' ELSE '' END AS docs FROM orders")
def _(v):
    return v.detail_pages().select("bid_id", F.array_join(posting.detail_documents("html", "url"), ";").alias("docs"))


@register("j17_enrich_from_details", V.sql("bids", """SELECT bid_id, CASE WHEN contact <> '' THEN contact WHEN bid_id % 2 = 0 THEN 'Marla Whitfield' ELSE '' END AS contact, CASE WHEN email <> '' THEN email WHEN bid_id % 3 = 0 THEN 'clerk' || bid_id || '@town.gov' ELSE '' END AS email,
    CASE WHEN deadline <> '' THEN deadline WHEN bid_id % 4 = 1 THEN strftime(order_day + INTERVAL 8 YEAR, '%-m/%-d/%Y') ELSE '' END AS deadline, bid_id % 9 = 4 AS addenda FROM bids"""))
def _(v):
    b = v.bids().withColumn("url", F.concat(F.lit("https://d.gov/bids/"), F.col("bid_id").cast("string")))
    return bid_ops.enrich_from_details(b, bid_ops.details_from_pages(v.detail_pages())).select("bid_id", "contact", "email", "deadline", "addenda")


_PLAIN = "lower(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_TERMS = " + ".join(f"CAST(contains(p, '{t}') AS INTEGER)" for t in vocab.GENERIC_BID_TERMS)


@register("c26_generic_bid_page", f"SELECT page_id, CASE WHEN length(html) < 200 THEN NULL WHEN length(trim(p)) >= 300 AND {_TERMS} >= 2 THEN 'generic' END AS verdict FROM (SELECT page_id, html, {_PLAIN} AS p FROM (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN '<p>Open bids and RFP list</p>' ELSE '' END AS html FROM pages))")
def _(v):
    extra = F.when(F.col("page_id") % 3 == 0, F.lit("<p>Open bids and RFP list</p>")).otherwise(F.lit(""))
    return v.table("pages").select("page_id", P.bid_page_platform(F.concat("html", extra)).alias("verdict"))


@register("c27_strict_bid_page", f"SELECT page_id, regexp_matches(h, '{rx(vocab.LOOSE_BID_MARKERS)}') AND page_id % 4 <> 0 AS loose, regexp_matches(h, '{rx(vocab.STRONG_BID_MARKERS)}') AND page_id % 4 <> 0 AS strict FROM (SELECT page_id, lower(html) || CASE WHEN page_id % 3 = 0 THEN 'sealed bid' ELSE '' END AS h FROM pages)")
def _(v):
    k = F.col("page_id")
    h = F.concat("html", F.when(k % 3 == 0, F.lit("Sealed BID")).otherwise(F.lit("")), F.when(k % 4 == 0, F.lit(" Business Improvement District")).otherwise(F.lit("")))
    return v.table("pages").select("page_id", P.is_bid_page(h).alias("loose"), P.is_bid_page(h, strict=True).alias("strict"))


# ---- best page of a site ------------------------------------------------------------
def _snapshot(v):
    """For registered domains: a front page, and for some a purchasing or a linked page."""
    k, name = F.col("c_custkey"), F.concat(F.lit("https://"), F.lower(V.town_name(F.col("c_custkey"))), F.lit(".gov"))
    long_text = F.concat(F.lit("<html><body><p>"), F.repeat(F.lit("Purchasing office. Request for proposal and open bids listed below. "), 8), F.lit("</p></body></html>"))
    front = F.concat(F.lit("<html><body>Welcome to "), F.when(k % 10 == 9, F.lit("nowhere")).otherwise(V.town_name(k)),
                     F.lit('<a href="/dept/vendor-opportunities">Vendor bid list</a></body></html>'))
    rows = F.array(F.when(k % 7 != 6, F.struct(name.alias("url"), front.alias("html"))),
                   F.when(k % 3 == 0, F.struct(F.concat(name, F.lit("/purchasing")).alias("url"), long_text.alias("html"))),
                   F.when(k % 3 == 1, F.struct(F.concat(name, F.lit("/dept/vendor-opportunities")).alias("url"), long_text.alias("html"))))
    pages = v.table("customer").select(F.inline(F.array_compact(rows)))
    return pages.withColumn("page_id", F.xxhash64("url"))


_SITE = f"SELECT c_custkey AS k, lower({V.sql_town_name('c_custkey')}) || '.gov' AS domain FROM customer"


@register("a22_best_bid_page", V.sql("", "SELECT domain, CASE WHEN k % 3 = 0 OR (k % 3 = 1 AND k % 7 <> 6) THEN 'found' ELSE 'not_found' END AS status, CASE WHEN k % 3 = 0 THEN 'https://' || domain || '/purchasing' WHEN k % 3 = 1 AND k % 7 <> 6 THEN 'https://' || domain || '/dept/vendor-opportunities' ELSE '' END AS bid_url FROM site", site=_SITE))
def _(v):
    snap = _snapshot(v)
    sites = v.registry().select("domain")
    tries = P.site_candidates(sites, discovery.homepages(sites, snap), snap)
    return P.best_bid_page(sites, tries, snap, P.bid_page_platform("html")).select("domain", "status", "bid_url")


@register("b6_discover_portals", V.sql("", "SELECT domain, CASE WHEN k % 3 = 0 OR (k % 3 = 1 AND k % 7 <> 6) THEN 'found' ELSE 'not_found' END AS status, CASE WHEN k % 3 = 0 THEN 'agency' WHEN k % 3 = 1 AND k % 7 <> 6 THEN 'custom' ELSE '' END AS platform FROM site WHERE k % 5 <> 0", site=_SITE))
def _(v):
    done = v.crawl().where("row_ord % 5 = 0").select(F.regexp_replace("domain", r"^www\.", "").alias("domain"))
    return discovery.discover_portals(v.registry(), _snapshot(v), F.lit("2026-08-01"), done).select("domain", "status", "platform")


_VERIFIED = """SELECT k, domain, CASE WHEN k % 7 = 6 THEN 'unreachable' WHEN k % 2 = 1 AND k % 10 = 9 THEN 'not_this_town' WHEN k % 3 IN (0, 1) THEN 'found' ELSE 'no_bid_page' END AS status,
    CASE WHEN k % 7 = 6 AND k % 2 = 0 THEN 'domain' WHEN k % 7 = 6 THEN '' WHEN k % 2 = 0 THEN 'domain' WHEN k % 10 = 9 THEN '' ELSE 'homepage' END AS owns FROM site"""


def _candidates(v):
    k = F.col("town_id")
    # odd towns carry a first name that is not in their domain but is on their front page
    return v.towns().select("state", F.when(k % 2 == 0, F.col("city")).otherwise(F.concat(F.lit("to "), F.col("city"))).alias("place"),
                            F.concat(F.lower("city"), F.lit(".gov")).alias("domain"), k.alias("row_ord"))


@register("b7_verify_candidates", V.sql("", "SELECT domain, status, owns FROM verified", site=_SITE, verified=_VERIFIED))
def _(v):
    return discovery.verify_candidates(_candidates(v).drop("row_ord"), _snapshot(v)).select("domain", "status", "owns")


@register("a14_status_tally", V.sql("", "SELECT status, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, status) AS place FROM verified GROUP BY status", site=_SITE, verified=_VERIFIED))
def _(v):
    from noticegrid.operators import directory
    return directory.status_tally(discovery.verify_candidates(_candidates(v).drop("row_ord"), _snapshot(v)))


@register("b7_promote", V.sql("", "SELECT domain, 'agency' AS platform, CASE WHEN k % 4 = 0 THEN '2025-01-01' ELSE '2026-08-01' END AS checked_date, owns AS verified_by FROM verified WHERE status = 'found'", site=_SITE, verified=_VERIFIED))
def _(v):
    c = _candidates(v)
    verified = discovery.verify_candidates(c.drop("row_ord"), _snapshot(v)).join(c.select("domain", "row_ord"), "domain")
    from noticegrid.operators import directory
    prior = c.where("row_ord % 4 = 0").select("domain", F.lit("2025-01-01").alias("checked_date"))
    return directory.promote_portals(verified, prior, F.lit("2026-08-01")).select("domain", "platform", "checked_date", "verified_by")


@register("j28_owns_domain", V.sql("", "SELECT domain, owns FROM (SELECT k, domain, CASE WHEN k % 2 = 0 THEN 'domain' WHEN k % 3 = 0 THEN 'homepage' ELSE '' END AS owns FROM site)", site=_SITE))
def _(v):
    home = F.when(F.col("row_ord") % 3 == 0, F.concat(F.lit("Welcome "), F.upper("place"))).otherwise(F.lit("Hello"))
    return _candidates(v).select("domain", urls.owns_domain("place", "domain", home).alias("owns"))


# ---- page budgets -------------------------------------------------------------------
_HITS = "SELECT l_suppkey AS search_id, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS seq, p.url, lower(regexp_extract(p.url, '//([^/:?#]+)', 1)) AS host FROM lineitem l JOIN pages p ON p.page_id = l.l_partkey // 8"


def _hits(v):
    """Every line item is one hit of a search on a page."""
    hits = v.table("lineitem").select(F.col("l_suppkey").alias("search_id"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"), F.floor(F.col("l_partkey") / 8).alias("page_id"))
    return hits.join(v.table("pages").select("page_id", "url"), "page_id").drop("page_id")


@register("w4_prioritize_pages", V.sql("", """SELECT search_id, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY CASE WHEN nth > 4 THEN 1 ELSE 0 END, seq) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id, host ORDER BY seq) AS nth FROM hits)) WHERE rank <= 24""", hits=_HITS))
def _(v):
    return P.prioritize_pages(_hits(v), budget=24).select("search_id", "url", "rank")


@register("w4_reading_order", V.sql("", """SELECT search_id, url, seq, row_number() OVER (PARTITION BY search_id ORDER BY CASE WHEN nth > 4 THEN 1 ELSE 0 END, seq) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id, host ORDER BY seq) AS nth FROM hits)""", hits=_HITS))
def _(v):
    return P.prioritize_pages(_hits(v)).select("search_id", "url", "seq", "rank")


@register("u2_distinct_links", V.sql("", "SELECT search_id, url, min(seq) AS seq FROM (SELECT * FROM hits UNION ALL SELECT search_id, seq + 5, url, host FROM hits) GROUP BY search_id, url", hits=_HITS))
def _(v):
    h = _hits(v)
    return P.distinct_links(h.unionByName(h.withColumn("seq", F.col("seq") + 5))).select("search_id", "url", "seq")


# ---- contacts -----------------------------------------------------------------------
def _site_pages(v):
    """Each site has up to three contact pages; every seventh sells leads, every ninth is not read."""
    k, name = F.col("c_custkey"), F.lower(V.town_name(F.col("c_custkey")))
    site = F.concat(F.lit("https://www."), name, F.when(k % 7 == 0, F.lit(".yelp.com")).otherwise(F.lit(".com")))
    first = F.concat(F.lit("<html><title>"), name, F.lit(" Concrete | Paving</title><script>555-123-4567</script>"), F.when(k % 4 == 0, F.lit("call (417) 555-0000 ")).otherwise(F.lit("")),
                     F.when(k % 5 == 0, F.concat(F.lit("owner@gmail.com office@"), name, F.lit(".com"))).otherwise(F.lit("")))
    second = F.concat(F.lit("noreply@x.com sales@"), name, F.lit(".com sales@"), name, F.lit(".com Tel 417-555-1111"))
    third = F.lit("late@gmail.com")
    rows = F.posexplode(F.array(F.when(k % 9 != 0, first), F.when(k % 3 != 0, second), F.when(k % 2 == 0, third)))
    return v.table("customer").select(site.alias("site"), rows.alias("path_rank", "html"))


_PROS = f"""SELECT *, CASE WHEN k % 9 <> 0 AND k % 4 = 0 THEN '(417) 555-0000' WHEN k % 3 <> 0 THEN '(417) 555-1111' ELSE '' END AS ph, k % 9 <> 0 AND k % 5 = 0 AS m0, k % 3 <> 0 AS m1, k % 2 = 0 AS m2,
    k % 9 <> 0 AND k % 4 = 0 AND k % 5 = 0 AS stop0, (k % 3 <> 0) AS stop1 FROM (SELECT c_custkey AS k, lower({V.sql_town_name('c_custkey')}) AS n FROM customer)"""
_PROSPECT = """SELECT 'https://www.' || n || CASE WHEN k % 7 = 0 THEN '.yelp.com' ELSE '.com' END AS site, CASE WHEN k % 7 = 0 THEN '' WHEN k % 9 <> 0 THEN n || ' concrete' ELSE '' END AS company_low,
    CASE WHEN k % 7 = 0 THEN '' ELSE ph END AS phone, CASE WHEN k % 7 = 0 THEN [] ELSE list_filter([CASE WHEN m0 THEN 'office@' || n || '.com' END, CASE WHEN m0 THEN 'owner@gmail.com' END, CASE WHEN m1 AND NOT stop0 THEN 'sales@' || n || '.com' END, CASE WHEN m2 AND NOT stop0 AND NOT stop1 THEN 'late@gmail.com' END], lambda x: x IS NOT NULL) END AS mails, k FROM pros"""


@register("a23_contacts_per_site", V.sql("", "SELECT site, phone, coalesce(mails[1], '') AS email, array_to_string(mails[2:4], ';') AS extra_emails, CASE WHEN len(mails) > 0 THEN 'ok' WHEN company_low <> '' THEN 'no_email' ELSE 'unreachable' END AS status FROM prospect WHERE k % 7 <> 0", pros=_PROS, prospect=_PROSPECT))
def _(v):
    return P.contacts_per_site(_site_pages(v).where(~F.col("site").endswith("yelp.com"))).select("site", "phone", "email", "extra_emails", "status")


@register("a23_contact_pages", V.sql("", "SELECT site, i AS path_rank, CASE WHEN contains(site, '//') THEN lower(site) ELSE 'https://' || lower(site) END || (['', '/contact', '/contact-us', '/contactus', '/about', '/about-us', '/get-a-quote', '/estimate'])[i + 1] AS url FROM (SELECT DISTINCT site FROM prospect), (SELECT unnest(range(8)) AS i)", pros=_PROS, prospect=_PROSPECT))
def _(v):
    return P.contact_pages(_site_pages(v).select("site").distinct())


@register("b9_prospects", V.sql("", "SELECT site, company_low, phone, coalesce(mails[1], '') AS email, CASE WHEN k % 7 = 0 THEN 'aggregator' WHEN len(mails) > 0 THEN 'ok' WHEN company_low <> '' THEN 'no_email' ELSE 'unreachable' END AS status FROM prospect", pros=_PROS, prospect=_PROSPECT))
def _(v):
    pages = _site_pages(v)
    rows = P.prospects(pages.select("site").distinct(), pages)
    return rows.select("site", F.lower("company").alias("company_low"), "phone", "email", "status")


# ---- audit --------------------------------------------------------------------------
_AUD = f"""SELECT page_id AS portal, count(*) AS rows, count(*) FILTER (WHERE {_REL}) AS niche_rows, count(*) FILTER (WHERE {_REL} AND status <> 'Closed' AND status <> 'Awarded') AS shown_open, 0 AS no_status,
    count(*) FILTER (WHERE {_REL} AND status = 'Open' AND due < DATE '2006-08-01') AS open_but_expired, 0 AS awarded_shown_open, count(*) FILTER (WHERE {_REL} AND status = 'Open' AND due IS NULL) AS shown_no_deadline FROM posted GROUP BY page_id"""
_LNK = f"SELECT page_id AS portal, count(*) AS links_checked, count(*) FILTER (WHERE k % 5 = 0) AS links_dead FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rn FROM posted WHERE {_REL}) WHERE k % 4 <> 0 GROUP BY page_id"
_AUDIT = "SELECT a.*, coalesce(links_checked, 0) AS links_checked, coalesce(links_dead, 0) AS links_dead FROM aud a LEFT JOIN lnk USING (portal)"
_AU = dict(posts=_POST, posted=_POSTED, aud=_AUD, lnk=_LNK, audit=_AUDIT)


def _alive(v):
    """Whether the link of a posting still answers; unknown for every fourth."""
    k = F.col("o_orderkey")
    return v.table("orders").select(F.concat(F.lit("https://t"), F.floor(k / 8).cast("string"), F.lit(".gov/bids.aspx?bidID="), k.cast("string")).alias("url"),
                                     F.when(k % 4 != 0, k % 5 != 0).alias("alive"))


def _audit(v):
    from noticegrid.operators import health
    rows = P.posting_rows(v.listing_pages()).select(F.col("page_id").alias("portal"), F.col("pos").alias("seq"), "title", "scope", "status", "deadline", "url")
    return health.feed_audit(rows, _alive(v), V.as_of())


@register("a11_feed_audit", V.sql("", "SELECT * FROM audit", **_AU))
def _(v):
    return _audit(v)


_TOT = """SELECT count(*) AS portals, sum(shown_open) AS shown_open, sum(open_but_expired) AS bad, sum(links_checked) AS links_checked, sum(links_dead) AS links_dead,
    CAST(round(CAST(sum(open_but_expired) * 100 AS DECIMAL(20,4)) / greatest(sum(shown_open), 1), 2) AS DOUBLE) AS stale_rate_pct, CAST(round(CAST(sum(links_dead) * 100 AS DECIMAL(20,4)) / greatest(sum(links_checked), 1), 2) AS DOUBLE) AS dead_link_pct FROM audit"""


@register("a11_audit_totals", V.sql("", "SELECT * FROM tot", **_AU, tot=_TOT))
def _(v):
    from noticegrid.operators import health
    return health.audit_totals(_audit(v)).select("portals", "shown_open", "bad", "links_checked", "links_dead", "stale_rate_pct", "dead_link_pct")


@register("t10_alert_throttle", V.sql("", "SELECT 'stale' AS fault, bad AS n FROM tot WHERE stale_rate_pct >= 5 AND bad >= 3 UNION ALL SELECT 'dead_links', links_dead FROM tot WHERE dead_link_pct >= 10 AND links_dead >= 3", **_AU, tot=_TOT))
def _(v):
    from noticegrid.operators import health
    return health.audit_faults(health.audit_totals(_audit(v))).select("fault", "n")


@register("b8_audit", V.sql("", "SELECT count(*) AS portals, sum(rows) AS rows, sum(niche_rows) AS niche_rows, sum(shown_open) AS shown_open, sum(open_but_expired) AS open_but_expired, sum(shown_no_deadline) AS shown_no_deadline, sum(links_checked) AS links_checked, sum(links_dead) AS links_dead FROM audit", **_AU))
def _(v):
    listing = v.listing_pages().withColumn("url", F.concat(F.substring_index("url", "/Bids.aspx", 1), F.lit(vocab.CIVICPLUS_AUDIT_QUERY)))
    portals = listing.select(F.concat(F.substring_index("url", "/Bids.aspx", 1), F.lit("/Bids.aspx")).alias("url"), F.lit("civicplus").alias("platform"))
    totals = discovery.audit(listing, portals, _alive(v), V.as_of())[1]
    return totals.select("portals", "rows", "niche_rows", "shown_open", "open_but_expired", "shown_no_deadline", "links_checked", "links_dead")


@register("a12_sample_portals", "SELECT url FROM (SELECT DISTINCT 'https://t' || (o_orderkey // 8) || '.gov/Bids.aspx' AS url FROM orders) ORDER BY md5(url || '7'), url LIMIT 40")
def _(v):
    from noticegrid.operators import health
    portals = v.listing_pages().select("url", F.lit("civicplus").alias("platform"))
    return health.sample_portals(portals, seed=7, n=40).select("url")
