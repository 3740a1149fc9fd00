"""Page corpora: links, postings, feeds, extraction output, page tests, site contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions import dates, posting, urls
from noticegrid.functions.relevance import declares_closed, looks_awarded, looks_relevant
from noticegrid.functions.text import clean, count_terms, has_any, html_to_text, read_once, slug, strip, text, unescape, visible
from noticegrid.operators.common import first_per_key, ranked_rows, top_k
from noticegrid.operators.containment import containing
from noticegrid.session import stage

# fixed values: markup of links and listings
ANCHOR = r'(?is)<a[^>]+href="([^"#][^"]*)"[^>]*>(.*?)</a>'
POSTING_LINK = r'(?is)<a[^>]+href="([^"]*Bids\.aspx\?bidID=\d+[^"]*)"[^>]*>(.*?)</a>'
POSTING_START = r'(?i)(?=<a[^>]+href="[^"]*Bids\.aspx\?bidID=\d)'
READ_ON = r"(?i)^read ?on\b"
FEED_LINK = r'(?i)href="([^"]*(?:RSSFeed\.aspx|rss\.aspx)[^"]*)"[^>]*>([^<]*)'
FEED_ITEM = r"(?is)<(?:\w+:)?item(?:\s[^>]*)?>(.*?)</(?:\w+:)?item\s*>"
EXTRACTED = ("array<struct<title:string,scope:string,status:string,deadline:string,contact:string,email:string,"
             "phone:string,value:string,url:string,city:string>>")


def _matches(c: Column | str, pattern: str, names: tuple[str, str]) -> Column:
    """Array of (names[0], names[1]) for the first two groups of every match."""
    first, second = (F.regexp_extract_all(text(c), F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.arrays_zip(first.alias(names[0]), second.alias(names[1]))


def anchors(pages: DataFrame) -> DataFrame:
    """One row per link of a page: position, href, visible label."""
    links = pages.select("page_id", "url", F.posexplode(_matches("html", ANCHOR, ("href", "label"))).alias("pos", "_a"))
    return links.select("page_id", "url", "pos", F.col("_a.href").alias("href"), clean("_a.label").alias("label"))


def link_candidates(pages: DataFrame, k: int | None = None, hints=vocab.LINK_HINTS, noise=vocab.LINK_NOISE,
                    carried: Sequence[str] = ("page_id",)) -> DataFrame:
    """Links per page that look like a bid page, most hints first, the first k on request; no shuffle.

    The links of one page stay in its row, so this scales with the number of pages.
    """
    links = F.transform(_matches("html", ANCHOR, ("href", "label")), lambda a: F.struct(
        F.lower(F.concat_ws(" ", a["href"], clean(a["label"]))).alias("blob"), a["href"].alias("href")))
    clear = F.filter(links, lambda a: ~has_any(a["blob"], noise) & has_any(a["blob"], hints))
    scored = F.transform(clear, lambda a, i: F.struct(
        (-count_terms(a["blob"], hints)).alias("score"), i.alias("pos"),
        urls.url_join(F.col("url"), unescape(a["href"])).alias("link")))
    step = pages.select(*carried, scored.alias("_s"))
    step = step.withColumn("_links", F.transform("_s", lambda s: s["link"]))
    once = F.filter("_s", lambda s, i: F.array_position(F.col("_links"), s["link"]) == i + 1)
    best = F.array_sort(once) if k is None else F.slice(F.array_sort(once), 1, k)
    return step.select(*carried, F.posexplode(best).alias("_i", "_b")).select(
        *carried, (F.col("_i") + 1).alias("rank"), F.col("_b.link").alias("link"), (-F.col("_b.score")).alias("hits"))


def link_for_title(pages: DataFrame, titles: DataFrame, min_len: int = vocab.MIN_TITLE_MATCH) -> DataFrame:
    """Per (page, title): the link whose label contains the title or the reverse, tightest first.

    Both texts have at least min_len characters; either way the shorter one asks under its rarest gram of that length.
    """
    wants = titles.select("page_id", "title", slug("title").alias("_want")).where(F.length("_want") >= min_len).distinct()
    labels = (anchors(pages).withColumn("_label", slug("label"))
              .where((F.col("_label") != "") & ~has_any(F.lower("href"), vocab.LINK_NOISE)))
    by_label = containing(wants, labels, "_want", "_label", ["page_id"], min_len, shorter=False)
    by_title = containing(labels.distinct(), wants, "_label", "_want", ["page_id"], min_len, shorter=False)
    found = by_label.unionByName(by_title)
    best = first_per_key(found, ["page_id", "title"], [F.length("_label"), F.col("pos")])
    return best.select("page_id", "title", urls.url_join("url", unescape("href")).alias("link"))


def posting_pieces(html: Column | str) -> Column:
    """A listing page cut before each title link, whole, without what comes before the first.

    The page is split at every posting link. A link whose visible text is 'Read on' goes on with the posting before
    it; the texts are tested once tags and blanks are gone, so a page may hold any number of them.
    """
    mark = "\u0001"
    starts = F.split(F.replace(text(html), F.lit(mark), F.lit(" ")), POSTING_START, -1)
    label = lambda p: visible(F.regexp_extract(p, POSTING_LINK, 2))
    goes_on = lambda p: ~p.rlike("^" + POSTING_START) | label(p).rlike(READ_ON)
    marked = F.transform(starts, lambda p: F.when(goes_on(p), p).otherwise(F.concat(F.lit(mark), p)))
    return F.filter(F.split(F.array_join(marked, ""), mark, -1), lambda p, i: i > 0)


def posting_rows(pages: DataFrame) -> DataFrame:
    """Postings of listing pages, each with its own 'Read on' link, status and dates; first piece of a link wins."""
    cut = pages.select("page_id", "url", F.posexplode(posting_pieces("html")).alias("pos", "_piece"))
    read = cut.select(
        "page_id", F.col("url").alias("page_url"), "pos", unescape(F.regexp_extract("_piece", POSTING_LINK, 1)).alias("_ref"),
        visible(F.regexp_extract("_piece", POSTING_LINK, 2)).alias("title"),
        visible(F.regexp_replace("_piece", r"(?is)^<a.*?</a>", "")).alias("_window"))
    rows = read.where(F.length("title") >= 4).select(
        "page_id", "page_url", "pos", "title",
        urls.url_join("page_url", "_ref").alias("url"),
        F.lit("").alias("scope"), dates.close_date("_window").alias("deadline"),
        dates.status_near("_window").alias("status"), F.lit("civicplus").alias("source"))
    return first_per_key(rows, ["page_id", "url"], [F.col("pos")])


def has_posting_link(html: Column) -> Column:
    """The pattern is looked for on pages that name a posting at all."""
    return F.contains(F.lower(html), F.lit("bids.aspx?bidid=")) & html.rlike(POSTING_LINK)


def page_is_empty(html: Column | str) -> Column:
    """A listing page for certain, with nothing posted on it."""
    low = F.lower(text(html))
    return (low != "") & ~has_posting_link(text(html)) & has_any(low, vocab.CIVICPLUS_PAGE_MARKERS)


def postings_from_pages(pages: DataFrame) -> DataFrame:
    """Postings on the trade, from listing pages of the recognised platform."""
    listing = pages.where(urls.identify_platform("url") == "civicplus")
    return posting_rows(listing).where(looks_relevant("title", "scope"))


def page_outcomes(pages: DataFrame) -> DataFrame:
    """Why each portal page gave no postings, or that it did."""
    listing = urls.identify_platform("url") == "civicplus"
    outcome = F.coalesce(F.col("outcome"), F.lit("ok")) if "outcome" in pages.columns else F.lit("ok")
    reason = (F.when(outcome != "ok", F.concat(F.lit("portal_fetch_"), outcome))
              .when(listing & has_posting_link(text("html")), F.lit("postings"))
              .when(listing & page_is_empty("html"), F.lit("civicplus_no_open_bids"))
              .when(listing, F.lit("civicplus_parse_miss"))
              # only pages of other platforms are read as text
              .when(~read_once(html_to_text("html"), looks_relevant), F.lit("portal_no_niche_content"))
              .otherwise(F.lit("for_extraction")))
    return pages.withColumn("reason", reason).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def feed_items(feeds: DataFrame) -> DataFrame:
    """Items of feed documents at any depth (inside a channel, or beside it as in RSS 1.0); a malformed document gives none.

    A document is parsed as a whole to know that it is well formed; its items are then read one by one.
    """
    sound = F.from_xml("xml", "_ok string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    good = feeds.where(F.isnull(sound["_corrupt"]))
    items = good.select("feed_id", F.posexplode(F.regexp_extract_all(text("xml"), F.lit(FEED_ITEM), F.lit(1))).alias("pos", "_i"))
    field = lambda name: _markup(F.regexp_extract("_i", rf"(?is)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}\s*>", 1))
    read = items.select("feed_id", "pos", visible(field("title")).alias("title"), strip(field("link")).alias("url"),
                        visible(field("description")).alias("scope")).where("title <> ''")
    closes = dates.close_date("scope")
    return read.select("*", F.when(closes != "", closes).otherwise(dates.close_date("title")).alias("deadline"),
                       dates.status_near("scope").alias("status"), F.lit("civicplus-rss").alias("source"))


def _markup(c: Column) -> Column:
    """Character data of an element: CDATA as it stands, entities read."""
    return F.when(c.contains("<![CDATA["), F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")).otherwise(unescape(c))


def bid_feed_link(pages: DataFrame) -> DataFrame:
    """The first feed link of a page that is about bids, made absolute; in-row."""
    links = F.transform(_matches("html", FEED_LINK, ("href", "label")), lambda a: F.struct(
        a["href"].alias("href"), F.lower(F.concat_ws(" ", unescape(a["href"]), clean(a["label"]))).alias("blob")))
    first = F.get(F.filter(links, lambda a: F.contains(a["blob"], F.lit("bid"))), 0)
    return pages.select("page_id", urls.absolute_feed_link(first["href"], "url").alias("feed")).where("feed <> ''")


def extraction_rows(outputs: DataFrame) -> DataFrame:
    """Bid objects inside model output text; anything that is not a JSON array gives none.

    Countdown deadlines are blanked. ``with_page_verdicts`` closes rows read from an award story.
    """
    body = F.regexp_extract(text("output"), r"(?s)(\[.*\])", 1)
    rows = outputs.select(*[c for c in outputs.columns if c != "output"],
                          F.posexplode(F.from_json(body, EXTRACTED, {"mode": "PERMISSIVE"})).alias("pos", "_b"))
    keep = [c for c in outputs.columns if c != "output"]
    return rows.where("_b is not null").select(
        *keep, "pos", *[text(f"_b.{f}").alias(f) for f in ("title", "scope", "status", "contact", "email", "phone", "value", "url", "city")],
        dates.clean_deadline("_b.deadline").alias("deadline"))


def with_page_verdicts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Status closed where the page reports an award, or declares its only bid closed."""
    n = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n"))
    flags = texts.join(n, "page_id").select(
        "page_id", (looks_awarded("page_text") | declares_closed("page_text", "_n")).alias("_over"))
    return rows.join(flags, "page_id", "left").withColumn(
        "status", F.when(F.col("_over"), F.lit("Closed")).otherwise(F.col("status"))).drop("_over")


# ---- page tests and the best page of a site -----------------------------------------
def bid_page_platform(html: Column | str) -> Column:
    """civicplus when postings are listed, generic when it reads like a bid page, else null."""
    generic = lambda plain: (F.length(plain) >= 300) & (count_terms(plain, vocab.GENERIC_BID_TERMS) >= 2)
    verdict = lambda h: F.when(F.length(h) >= 200, F.when(has_posting_link(h), F.lit("civicplus"))
                               .when(read_once(F.lower(clean(h)), generic), F.lit("generic")))
    return read_once(text(html), verdict)


def is_bid_page(html: Column | str, strict: bool = False) -> Column:
    low = F.lower(text(html))
    markers = vocab.STRONG_BID_MARKERS if strict else vocab.LOOSE_BID_MARKERS
    return ~has_any(low, vocab.NOT_A_BID_PAGE) & has_any(low, markers)


PROBE_PATHS = (*vocab.CANDIDATE_PATHS, *[p for p in vocab.CIVICPLUS_PATHS if p not in vocab.CANDIDATE_PATHS])


def site_candidates(sites: DataFrame, homepages: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(domain, rank, url, guessed) to look at per site: guessed paths, then the listing endpoints of the common platform, then homepage links.

    With ``pages`` the guesses are those among the pages that were read: each page is cut where a guessed path ends it, so a few rows
    a page are shuffled, not some thirty guesses a site of which nearly all would be looked up in vain.
    """
    if pages is None:
        guessed = sites.select("domain", F.explode(urls.candidate_urls("domain", PROBE_PATHS)).alias("_c")).select(
            "domain", F.col("_c.rank").alias("rank"), F.col("_c.url").alias("url"), F.lit(True).alias("guessed"))
    else:
        read = pages.select("url").distinct().select("url", F.explode(urls.ends_of("url", PROBE_PATHS)).alias("_c"))
        based = sites.select("domain", urls.site_base("domain").alias("_base"))
        guessed = read.select("url", F.col("_c.rank").alias("rank"), F.col("_c.base").alias("_base")).join(based, "_base").select(
            "domain", "rank", "url", F.lit(True).alias("guessed"))
    home = homepages.select("url", "html", urls.host_of("url").alias("domain")).join(sites.select("domain"), "domain", "left_semi")
    linked = link_candidates(home, carried=["domain"]).select(
        "domain", (F.col("rank") + len(PROBE_PATHS)).alias("rank"), F.col("link").alias("url"), F.lit(False).alias("guessed"))
    return guessed.unionByName(linked)


def best_bid_page(sites: DataFrame, candidates: DataFrame, pages: DataFrame, verdict: Column) -> DataFrame:
    """First candidate page per site that passes; others not_found. verdict is a platform or null."""
    asked = pages.join(candidates.select("url").distinct(), "url", "left_semi")
    tested = asked.withColumn("_v", verdict).where("_v is not null").select("url", "_v")
    hits = candidates.join(tested, "url").groupBy("domain").agg(F.min(F.struct("rank", "url", "_v")).alias("_h"))
    platform = F.when(F.col("_h._v") == "civicplus", F.lit("civicplus")).otherwise(
        F.coalesce(F.nullif(urls.identify_platform("_h.url"), F.lit("")), F.lit("custom")))
    found = F.col("_h").isNotNull()
    return sites.join(hits, "domain", "left").select(
        *sites.columns, F.when(found, F.lit("found")).otherwise(F.lit("not_found")).alias("status"),
        F.coalesce("_h.url", F.lit("")).alias("bid_url"), F.when(found, platform).otherwise(F.lit("")).alias("platform"))


# ---- page budgets and distinct links ------------------------------------------------
def distinct_links(hits: DataFrame) -> DataFrame:
    """First sighting of each url per search."""
    return first_per_key(hits, ["search_id", "url"], [F.col("seq")])


def prioritize_pages(hits: DataFrame, budget: int | None = None,
                     per_domain: int = vocab.MAX_PAGES_PER_DOMAIN) -> DataFrame:
    """Pages of each search in reading order: trusted listing first, government next, few per domain before more of it.

    ``budget`` keeps the first so many; without it every page has its rank.
    """
    host = urls.full_host("url")
    ranked = hits.withColumn("host", host).withColumn(
        "_bidnet", F.when(F.contains("host", F.lit("bidnetdirect.com")), F.lit(0)).otherwise(F.lit(1))).withColumn(
        "_gov", F.when(urls.is_gov_domain("host"), F.lit(0)).otherwise(F.lit(1)))
    order = [F.col("_bidnet"), F.col("_gov"), F.col("seq")]
    cut = ranked_rows(ranked, ["search_id", "host"], order, budget, "_nth")
    over = F.when(F.col("_nth") > per_domain, F.lit(1)).otherwise(F.lit(0))
    return ranked_rows(cut, ["search_id"], [over, *order], budget, "rank").drop("_bidnet", "_gov", "_nth")


# ---- site contacts ------------------------------------------------------------------
def contact_pages(sites: DataFrame) -> DataFrame:
    """(site, path_rank, url) of the pages that may name a contact, in reading order."""
    tries = sites.select("site", F.explode(urls.candidate_urls("site", vocab.CONTACT_PATHS)).alias("_c"))
    return tries.select("site", F.col("_c.rank").alias("path_rank"), F.col("_c.url").alias("url"))


def contacts_per_site(site_pages: DataFrame) -> DataFrame:
    """Company, addresses and phone per site from its contact pages, read in path order until
    both an address and a phone number are known. Rows: site, path_rank, html (null: not read).
    """
    read = site_pages.select("site", "path_rank", text("html").alias("_h"), urls.full_host("site").alias("_host")).where("_h <> ''")
    facts = stage(read.select("site", "path_rank", posting.page_title("_h").alias("_title"), posting.site_phone("_h").alias("_phone"),
                              posting.site_emails("_h", "_host").alias("_mails")), "site-facts")
    has_mail = F.size("_mails") > 0
    per_site = facts.groupBy("site").agg(
        F.min_by("_title", F.when(F.col("_title") != "", F.col("path_rank"))).alias("company"),
        F.min_by("_phone", F.when(F.col("_phone") != "", F.col("path_rank"))).alias("phone"),
        F.min(F.when(F.col("_phone") != "", F.col("path_rank"))).alias("_p"), F.min(F.when(has_mail, F.col("path_rank"))).alias("_m"))
    stop = F.when(F.col("_p").isNotNull() & F.col("_m").isNotNull(), F.greatest("_p", "_m"))
    mails = (facts.where(has_mail).join(per_site.select("site", stop.alias("_stop")), "site")
             .where(F.col("_stop").isNull() | (F.col("path_rank") <= F.col("_stop")))
             .select("site", "path_rank", F.posexplode("_mails").alias("_pos", "email"))
             .groupBy("site", "email").agg(F.min(F.struct("path_rank", "_pos")).alias("_at")))
    best = (top_k(mails, ["site"], [F.col("_at")], 4, "_rank").groupBy("site")
            .agg(F.array_sort(F.collect_list(F.struct("_rank", "email"))).alias("_l")))
    names = F.transform("_l", lambda x: x["email"])
    sites = site_pages.select("site").distinct()
    first_phone = F.when(F.col("_stop_phone").isNull(), F.lit("")).otherwise(F.col("phone"))
    joined = sites.join(per_site.withColumn("_stop_phone", F.col("_p")), "site", "left").join(best, "site", "left")
    return joined.select(
        "site", text("company").alias("company"), F.coalesce(F.get(names, 0), F.lit("")).alias("email"),
        F.coalesce(F.array_join(F.slice(names, 2, 3), ";"), F.lit("")).alias("extra_emails"), text(first_phone).alias("phone"),
        F.when(F.col("_l").isNotNull(), F.lit("ok")).when(text("company") != "", F.lit("no_email"))
        .otherwise(F.lit("unreachable")).alias("status"))


def prospects(seeds: DataFrame, site_pages: DataFrame) -> DataFrame:
    """One row per seed site; lead-selling aggregators are named, not read."""
    aggregator = has_any(urls.full_host("site"), vocab.PROSPECT_JUNK_HOST)
    contacts = contacts_per_site(site_pages)
    rows = seeds.withColumn("_agg", aggregator).join(contacts, "site", "left")
    blank = lambda c: F.when(F.col("_agg"), F.lit("")).otherwise(text(c)).alias(c)
    return rows.select(*seeds.columns, *[blank(c) for c in ("company", "email", "extra_emails", "phone")],
                       F.when(F.col("_agg"), F.lit("aggregator")).otherwise(F.coalesce("status", F.lit("unreachable"))).alias("status"))


def recall(kept: DataFrame, expected: DataFrame) -> DataFrame:
    """Which expected title fragments (column ``expected``) are among the kept titles, and the share of them.

    Both sides are distinct before they meet. A blank fragment is found where there is any title.
    """
    # written: titles are listed under their grams twice and counted, and may come from whole pages
    titles = stage(kept.select(F.lower(text("title")).alias("_title")).distinct(), "titles")
    wants = expected.select("expected").distinct().withColumn("_want", F.lower(text("expected")))
    hits = containing(wants, titles, "_want", "_title").select("expected").distinct().withColumn("_hit", F.lit(True))
    blank = (F.lower(text("expected")) == "") & titles.agg(F.count(F.lit(1)) > 0).scalar()
    rows = expected.select("expected").join(hits.withColumnRenamed("expected", "_e"), F.col("expected").eqNullSafe(F.col("_e")), "left").select(
        "expected", (F.coalesce("_hit", F.lit(False)) | blank).alias("found"))
    return rows.withColumn("recall", rows.agg(F.avg(F.col("found").cast("int"))).scalar())
