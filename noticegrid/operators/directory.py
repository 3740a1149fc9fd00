"""The directory of source pages: seeding, learning, health, registry look-ups, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions import places, urls
from noticegrid.functions.text import col, filled, slug, text
from noticegrid.operators.common import first_per_key, insert_missing, rank_all, ranked_rows, subtract_keys, tally
from noticegrid.operators.containment import containing

HEALTH = ["source", "added", "last_ok", "last_checked", "fail_count"]


def seed_directory(tiers: DataFrame, today: Column) -> DataFrame:
    """Rows of the best tier per town; a tier fills only towns no earlier tier has.

    ``tiers`` carries tier (0 = stored), and stored rows keep their health columns.
    """
    best = tiers.groupBy("city_key").agg(F.min("tier").alias("tier"))
    stored = F.col("tier") == 0
    return tiers.join(best, ["city_key", "tier"]).select(
        "city_key", "url", "platform", "tier",
        F.when(stored, F.col("source")).when(F.col("tier") == 1, F.lit("seed"))
        .when(F.col("tier") == 2, F.lit("national_crawl")).otherwise(F.lit("wikidata")).alias("source"),
        F.when(stored, F.col("added")).otherwise(today).alias("added"),
        F.when(stored, F.col("last_ok")).alias("last_ok"),
        F.when(stored, F.col("last_checked")).alias("last_checked"),
        F.when(stored, F.coalesce("fail_count", F.lit(0))).otherwise(F.lit(0)).alias("fail_count"))


def learn_portals(portals: DataFrame, found: DataFrame, today: Column) -> DataFrame:
    """New (town, url) pages of a scan; aggregators and known pages are not learned."""
    fresh = found.where((text("url") != "") & ~urls.is_aggregator_url("url"))
    new = insert_missing(portals, fresh, ["city_key", "url"], [F.col("seq")])
    platform = F.coalesce(filled("platform"), F.lit("custom")) if "platform" in found.columns else F.lit("custom")
    return new.select("city_key", "url", platform.alias("platform"), F.lit("learned").alias("source"),
                      today.alias("added"), today.alias("last_ok"), today.alias("last_checked"),
                      F.lit(0).alias("fail_count"))


def fetch_runs(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: last success, last check and failures after the last success.

    Two partial aggregations (last success, then failures later than it), so a key with many
    results is never sorted or gathered in one task.
    """
    last_ok = results.groupBy(*keys).agg(
        F.max(F.when(F.col("ok"), F.struct("ts", "seq"))).alias("_ok"), F.max("ts").alias("checked_at"))
    later = F.col("_ok").isNull() | (F.struct("ts", "seq") > F.col("_ok"))
    fails = (results.where(~F.col("ok")).join(last_ok, keys).where(later)
             .groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("run_fails")))
    return last_ok.join(fails, keys, "left").select(
        *keys, F.col("_ok.ts").alias("ok_at"), "checked_at",
        F.coalesce("run_fails", F.lit(0)).alias("run_fails"))


def record_results(portals: DataFrame, results: DataFrame) -> DataFrame:
    """Directory with its health columns moved on by a batch of fetch results."""
    runs = fetch_runs(results, ["city_key", "url"])
    hit = F.col("checked_at").isNotNull()
    carried = F.when(F.col("ok_at").isNotNull(), F.lit(0)).otherwise(F.coalesce("fail_count", F.lit(0)))
    return portals.join(runs, ["city_key", "url"], "left").select(
        *[c for c in portals.columns if c not in ("last_ok", "last_checked", "fail_count")],
        F.coalesce(F.col("ok_at").cast("date"), F.col("last_ok")).alias("last_ok"),
        F.coalesce(F.col("checked_at").cast("date"), F.col("last_checked")).alias("last_checked"),
        F.when(hit, carried + F.col("run_fails")).otherwise(F.coalesce("fail_count", F.lit(0)))
        .cast("int").alias("fail_count"))


def rank_domains(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered domains of each (city, state), best first: type, names the town, domain."""
    keyed = registry.withColumn("city_key", places.place_key("city", "state"))
    asked = wanted.select(places.place_key("city", "state").alias("city_key"),
                          slug("city").alias("_want")).where("_want <> ''").distinct()
    named = F.contains(F.concat(slug("org"), slug("domain")), F.col("_want"))
    ranked = asked.join(keyed, "city_key").withColumn("type_rank", places.type_rank("type")).withColumn(
        "names_town", F.when(named, F.lit(0)).otherwise(F.lit(1)))
    return ranked.select("city_key", "domain", "type", "org", "type_rank", "names_town")


def known_domains(wanted: DataFrame, registry: DataFrame, k: int | None = None) -> DataFrame:
    """Registered domains of each town, best first; the first k on request."""
    return ranked_rows(rank_domains(wanted, registry), ["city_key"],
                       [F.col("type_rank"), F.col("names_town"), F.col("domain")], k, "rank")


def states_for_org(names: DataFrame, registry: DataFrame, min_len: int = vocab.MIN_ORG_MATCH) -> DataFrame:
    """(name, state) for every registered body whose organisation or domain contains the name.

    Names are distinct, so the work grows with the vocabulary; each asks under its rarest gram.
    """
    asked = names.select("name").distinct().withColumn("_want", slug("name"))
    bodies = registry.select(F.concat(slug("org"), F.lit("|"), slug("domain")).alias("_blob"), "state").distinct()
    return containing(asked, bodies, "_want", "_blob", size=min_len, shorter=False).select("name", "state").distinct()


def known_in_state(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """(city, state) names registered there as a place or as part of a body's name."""
    asked = wanted.select("city", "state").where(text("state") != "").distinct()
    by_place = asked.withColumn("city_key", places.place_key("city", "state")).join(
        registry.select(places.place_key("city", "state").alias("city_key")).distinct(), "city_key", "left_semi"
    ).select("city", "state")
    orgs = states_for_org(asked.select(F.col("city").alias("name")), registry)
    by_org = asked.join(orgs.select(F.col("name").alias("city"), "state"), ["city", "state"], "left_semi")
    return by_place.unionByName(by_org).distinct()


def domain_index(crawl: DataFrame) -> DataFrame:
    """host -> town over all directory files and any status; the first row of a host wins."""
    rows = crawl.select(
        F.regexp_replace(F.lower(F.trim(text("domain"))), r"^www\.", "").alias("host"),
        F.trim(text("city")).alias("city"), F.upper(F.trim(text("state"))).alias("state"), "file_ord", "row_ord",
    ).where("host <> '' and city <> '' and state <> ''")
    return first_per_key(rows, ["host"], [F.col("file_ord"), F.col("row_ord")]).select(
        "host", "city", "state", places.place_key("city", "state").alias("city_key"))


def town_for_url(links: DataFrame, index: DataFrame) -> DataFrame:
    return links.withColumn("host", urls.host_of("url")).join(index, "host", "left")


def coords_for_town(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    points = gazetteer.select(places.place_key("city", "state").alias("city_key"), "lat", "lon")
    return rows.withColumn("city_key", places.place_key("city", "state")).join(points, "city_key", "left")


def candidate_domains(harvest: DataFrame, known: DataFrame) -> DataFrame:
    """Harvested town sites not in the directory; junk hosts out, first state of a host wins."""
    hosts = harvest.select(urls.host_of("website").alias("domain"), "state", "place").where(
        (F.col("domain") != "") & ~urls.is_junk_host("domain"))
    known_hosts = known.select(F.regexp_replace(F.lower(text("domain")), r"^www\.", "").alias("domain"))
    return first_per_key(subtract_keys(hosts, known_hosts, ["domain"]), ["domain"],
                         [F.col("state"), F.col("place")]).select("state", "place", "domain")


def distinct_towns(lists: DataFrame) -> DataFrame:
    """One spelling per town over several lists; the first list, then row, wins."""
    rows = lists.select(F.trim(text("city")).alias("city"), F.upper(F.trim(text("state"))).alias("state"),
                        "list_ord", "row_ord").where("city <> '' and state <> ''").withColumn(
        "city_key", places.place_key("city", "state"))
    return first_per_key(rows, ["city_key"], [F.col("list_ord"), F.col("row_ord")]).select("city", "state")


def promote_portals(verified: DataFrame, prior: DataFrame, today: Column) -> DataFrame:
    """Verified candidates as directory rows, one per domain, keeping earlier check dates."""
    rows = verified.where((F.col("status") == "found") & (text("bid_url") != "")).select(
        F.lower(F.trim(text("domain"))).alias("domain"), F.upper(F.trim(text("state"))).alias("state"),
        "place", "bid_url", "owns", "row_ord",
    ).withColumn("city", places.clean_city_label("place", "state")).where(
        "domain <> '' and city <> '' and state <> ''")
    one = first_per_key(rows, ["domain"], [F.col("row_ord")])
    dates = prior.groupBy("domain").agg(F.max("checked_date").alias("_prior"))
    return one.join(dates, "domain", "left").select(
        "domain", "city", "state", places.entity_type("city").alias("type"), F.col("city").alias("org"),
        F.lit("found").alias("status"), "bid_url",
        F.when(F.lower("bid_url").endswith("/bids.aspx"), F.lit("civicplus")).otherwise(F.lit("agency")).alias("platform"),
        F.coalesce("_prior", today).alias("checked_date"), F.lit("wikidata").alias("source"),
        text("owns").alias("verified_by"))


def directory_stats(portals: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Pages per source, and geocoded towns."""
    by_source = tally(portals, F.concat(F.lit("portals:"), F.col("source")).alias("metric"))
    towns = gazetteer.agg(F.count(F.lit(1)).alias("n")).select(F.lit("geocoded_towns").alias("metric"), "n")
    return by_source.unionByName(towns)


def found_rate(crawl: DataFrame, *keys: str) -> DataFrame:
    found, probed = F.count_if(F.col("status") == "found"), F.count(F.lit(1))
    return crawl.groupBy(*keys).agg(
        found.alias("found"), probed.alias("probed"),
        F.round((found * 100).cast("decimal(20,4)") / probed, 2).cast("double").alias("rate_pct"))


def status_tally(rows: DataFrame) -> DataFrame:
    """Rows per status with its place by count; a table of a few statuses."""
    return tally(rows, "status").withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "status")))


def refreshed_registry(raw: DataFrame) -> DataFrame:
    """The registry kept to local government, normalised."""
    return raw.where(F.trim(F.col("domain_type")).isin(*vocab.TYPE_ORDER)).select(
        F.lower(F.trim(text("domain_name"))).alias("domain"), F.trim(col("domain_type")).alias("type"),
        F.trim(text("organization_name")).alias("org"), F.trim(text("city")).alias("city"),
        F.upper(F.trim(text("state"))).alias("state")).where("domain <> '' and state <> ''")


def registry_order(registry: DataFrame, limit: int | None = None) -> DataFrame:
    """Cities, counties, then districts, with the place of each; a limit takes the head of that order."""
    kind = places.type_rank("type")
    ranked = rank_all(registry, [], [kind, F.substring("domain", 1, 2)], [kind, F.col("domain")], "place")
    return ranked.where(F.col("place") <= limit) if limit else ranked


def newly_found(crawl: DataFrame, rechecked: DataFrame) -> DataFrame:
    """Rows of domains that a recheck found and the crawl had missed."""
    hits = rechecked.where(F.col("status") == "found").select(*crawl.columns)
    return hits.join(crawl.where(F.col("status") != "found").select("domain").distinct(), "domain", "left_semi")


def recheck_misses(crawl: DataFrame, rechecked: DataFrame) -> DataFrame:
    """Crawl rows with newly found domains rewritten in place; everything else as it was."""
    hits = newly_found(crawl, rechecked)
    return subtract_keys(crawl, hits, ["domain"]).unionByName(hits)


def next_states(states: DataFrame, covered: DataFrame, batch: int = 8) -> DataFrame:
    """Next states of the prospecting round, in order; the state list is a fixed table."""
    left = subtract_keys(states, covered, ["state"])
    return left.orderBy("ord").limit(batch)
