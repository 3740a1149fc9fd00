"""State over time from logs, in batch form: failures, cooldowns, limits, clocks, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions import dates, relevance
from noticegrid.functions.text import has_any, text
from noticegrid.operators.common import subtract_keys, tally, top_k
from noticegrid.operators.directory import fetch_runs
from noticegrid.session import stage


def failure_streaks(log: DataFrame, keys: list[str], trip: int) -> DataFrame:
    """Consecutive failures per key and whether they reached ``trip``."""
    runs = fetch_runs(log, keys)
    return runs.select(*keys, F.col("run_fails").alias("fail_count"), F.col("ok_at").alias("last_ok"),
                       F.col("checked_at").alias("last_checked"), (F.col("run_fails") >= trip).alias("tripped"))


def portal_health(log: DataFrame) -> DataFrame:
    return failure_streaks(log, ["portal"], vocab.MAX_FAIL).withColumn("trusted", ~F.col("tripped")).drop("tripped")


def search_degraded(log: DataFrame, keys: list[str]) -> DataFrame:
    """A provider is degraded after eight empty results in a row. ``ok`` means it found something."""
    return failure_streaks(log, keys, vocab.SEARCH_TRIP).select(*keys, F.col("fail_count").alias("empty_streak"), F.col("tripped").alias("degraded"))


def provider_cooldown(log: DataFrame, keys: list[str], as_of: Column, seconds: int = vocab.COOLDOWN_SEC) -> DataFrame:
    """Providers benched until some seconds after their last refusal, unless a success came later."""
    refused = F.col("status").isin(*vocab.COOLDOWN_STATUSES)
    last = log.where(refused | F.col("ok")).groupBy(*keys).agg(
        F.max(F.struct("ts", "seq", refused.alias("refused"))).alias("_l"))
    until = F.when(F.col("_l.refused"), F.timestamp_add("SECOND", F.lit(seconds), F.col("_l.ts")))
    return last.select(*keys, until.alias("down_until"), F.coalesce(as_of < until, F.lit(False)).alias("down"))


def provider_health(log: DataFrame, keys: list[str]) -> DataFrame:
    failed = ~F.col("ok")
    per = log.groupBy(*keys).agg(F.count_if("ok").alias("ok_n"), F.count_if(failed).alias("failed_n"),
                                 F.max(F.when(failed, F.struct("ts", "seq", "status"))).alias("_l"))
    last = F.coalesce(F.col("_l.status"), F.lit(0))
    return per.select(*keys, "ok_n", "failed_n", last.alias("last_status"), last.isin(*vocab.QUOTA_STATUSES).alias("quota_or_auth_failure"),
                      ((F.col("failed_n") > 0) & (F.col("ok_n") == 0)).alias("failing"))


def daily_rate_limit(posts: DataFrame, k: int = vocab.NOTICES_PER_DAY) -> DataFrame:
    """First k posts per sender and calendar day."""
    return top_k(posts.withColumn("day", F.col("ts").cast("date")), ["sender", "day"], [F.col("ts"), F.col("seq")], k)


def miss_retry(cache: DataFrame, as_of: Column, hours: int = vocab.MISS_RETRY_HOURS) -> DataFrame:
    """Look-ups to try again: misses older than a day, or misses of unknown age. Hits are for ever."""
    fresh = F.timestamp_diff("MICROSECOND", F.col("missed_at"), as_of) < hours * 3_600_000_000
    return cache.where(F.col("lat").isNull() & ~F.coalesce(fresh, F.lit(False)))


def first_seen_clock(sightings: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """First day each signature was seen; unreadable stored days restart the clock."""
    seen = sightings.select("sig", F.col("seen").cast("date").alias("seen_date"))
    if store is not None:
        kept = store.select("sig", F.col("seen_date").cast("string").try_cast("date").alias("seen_date")).where("seen_date is not null")
        seen = seen.unionByName(kept)
    return seen.groupBy("sig").agg(F.min("seen_date").alias("first_seen"))


def evict_oldest(clock: DataFrame, k: int) -> DataFrame:
    """The k newest entries of each store, for a store that has to be of bounded size."""
    return top_k(clock, ["store"], [F.desc("first_seen"), F.col("sig")], k)


def retire_old(clock: DataFrame, as_of: Column, days: int = 2 * vocab.UNDATED_MAX_DAYS) -> DataFrame:
    """The entries that still matter: a bid is closed by age long before its clock is forgotten."""
    return clock.where(F.datediff(as_of.cast("date"), F.col("first_seen")) <= days)


def same_day(cache: DataFrame, as_of: Column) -> DataFrame:
    """Cached results of today; earlier days are gone."""
    return cache.where(F.col("run_date") == as_of.cast("date"))


def to_compute(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Requests without a result of today, or forced."""
    forced = requests.where("force")
    return subtract_keys(requests.where("not force"), same_day(cache, as_of), ["cache_key"]).unionByName(forced)


# ---- feed quality -------------------------------------------------------------------
AUDIT_COUNTS = ["rows", "niche_rows", "shown_open", "no_status", "open_but_expired", "awarded_shown_open",
                "shown_no_deadline", "links_checked", "links_dead"]


def feed_audit(postings: DataFrame, link_status: DataFrame, as_of: Column, links_per_portal: int | None = None) -> DataFrame:
    """Per portal: what a customer would be shown and what is wrong with it; all links are checked, or the first few."""
    status = F.trim(text("status"))
    judged = postings.withColumn("niche", relevance.looks_relevant("title", "scope")).withColumn(
        "due", dates.parse_deadline("deadline"))
    judged = judged.withColumn("shown", F.col("niche") & relevance.is_open(status))
    judged = stage(judged.select("portal", "seq", "url", "status", "niche", "due", "shown"), "audited")
    counts = judged.groupBy("portal").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("niche").alias("niche_rows"), F.count_if("shown").alias("shown_open"),
        F.count_if(status == "").alias("no_status"),
        F.count_if(F.col("shown") & (F.col("due") < as_of.cast("date"))).alias("open_but_expired"),
        F.count_if(F.col("shown") & F.lower(status).startswith("award")).alias("awarded_shown_open"),
        F.count_if(F.col("shown") & F.col("due").isNull()).alias("shown_no_deadline"))
    links = judged.where("niche and url <> ''").select("portal", "seq", "url")
    links = links if links_per_portal is None else top_k(links, ["portal"], [F.col("seq")], links_per_portal)
    alive = link_status.groupBy("url").agg(F.bool_and("alive").alias("alive"))
    checked = links.join(alive, "url").where("alive is not null").groupBy("portal").agg(
        F.count(F.lit(1)).alias("links_checked"), F.count_if(~F.col("alive")).alias("links_dead"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("links_checked", "links_dead")]
    return counts.join(checked, "portal", "left").select("portal", *AUDIT_COUNTS[:7], *zero)


def audit_totals(audit: DataFrame) -> DataFrame:
    """Totals over the portals with the three fault rates in percent."""
    t = audit.agg(F.count(F.lit(1)).alias("portals"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in AUDIT_COUNTS])
    pct = lambda n, d: F.round((n * 100).cast("decimal(20,4)") / F.greatest(d, F.lit(1)), 2).cast("double")
    bad = F.col("open_but_expired") + F.col("awarded_shown_open")
    return t.select("*", bad.alias("bad"), pct(bad, F.col("shown_open")).alias("stale_rate_pct"),
                    pct(F.col("shown_no_deadline"), F.col("shown_open")).alias("undated_pct"),
                    pct(F.col("links_dead"), F.col("links_checked")).alias("dead_link_pct"))


def audit_faults(totals: DataFrame) -> DataFrame:
    """Faults worth an alert; each needs a rate and a floor."""
    stale = (F.col("stale_rate_pct") >= 5) & (F.col("bad") >= 3)
    dead = (F.col("dead_link_pct") >= 10) & (F.col("links_dead") >= 3)
    faults = F.array(
        F.when(stale, F.struct(F.lit("stale").alias("fault"), F.col("bad").alias("n"), F.col("shown_open").alias("of"))),
        F.when(dead, F.struct(F.lit("dead_links").alias("fault"), F.col("links_dead").alias("n"), F.col("links_checked").alias("of"))))
    return totals.select(F.inline(F.array_compact(faults)))


def degraded_alerts(providers: DataFrame) -> DataFrame:
    return providers.where("degraded").select(F.lit("search_blocked").alias("fault"), "*")


def sample_portals(portals: DataFrame, seed: int = 0, n: int | None = None) -> DataFrame:
    """Listing portals with the show-everything view to audit: all, or a repeatable random sample of n."""
    base = F.substring_index("url", "/Bids.aspx", 1)
    listing = portals.where((F.col("platform") == "civicplus") & (text("url") != ""))
    if n is not None:
        listing = listing.withColumn("_r", F.md5(F.concat("url", F.lit(str(seed))))).orderBy("_r", "url").limit(n).drop("_r")
    return listing.withColumn("audit_url", F.concat(base, F.lit(vocab.CIVICPLUS_AUDIT_QUERY)))


def category_profile(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per data set: the first of its columns that holds a category of the trade, and the most frequent such value.

    ``catalog``: dataset, columns (names in their order). ``rows``: dataset, row (VARIANT), rows of any shape. Columns are
    chosen by name, and a data set needs coordinates or an address column. The values of all data sets are counted in one
    aggregation; only counts meet the catalog.
    """
    name = lambda c: F.lower(c)
    any_name = lambda *terms: F.exists("columns", lambda c: reduce(Column.__or__, [F.contains(name(c), F.lit(t)) for t in terms]))
    located = (any_name("latitude") & any_name("longitude")) | any_name("address")
    chosen = lambda c: has_any(name(c), vocab.CATEGORY_HINTS) & ~has_any(name(c), vocab.CATEGORY_EXCLUDE)
    fields = catalog.where(located).select("dataset", F.posexplode("columns").alias("pos", "field"))
    values = rows.select("dataset", F.explode(F.col("row").cast("map<string,string>")).alias("field", "value")).where(chosen(F.col("field")) & (F.col("value") != ""))
    good = tally(values, "dataset", "field", "value").where(
        (F.col("n") >= vocab.CATEGORY_MIN_COUNT) & has_any(F.lower("value"), vocab.CATEGORY_VALUE_TERMS))
    return top_k(good.join(fields, ["dataset", "field"]), ["dataset"], [F.col("pos"), F.desc("n"), F.col("value")], 1).select(
        "dataset", "field", "value", "n")
