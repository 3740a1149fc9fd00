"""Subscribers' feeds for all users at once: filters, tiles, sort orders, merges, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrid.functions import dates, keys, leads, money, relevance
from noticegrid.functions.text import blob, filled, first_filled, text
from noticegrid.operators.common import insert_missing, subtract_keys, tally


def feed_filter(rows: DataFrame, *, city=None, keyword=None, trade=None) -> DataFrame:
    return rows.where(relevance.matches_feed("title", "scope", "city", in_city=city, keyword=keyword, trade=trade))


def upcoming_filter(rows: DataFrame, keyword: str) -> DataFrame:
    k = keyword.strip().lower()
    return rows.where(F.contains(blob("title", "scope", "city"), F.lit(k))) if k else rows


def pipeline_filter(rows: DataFrame, choice: str, column: str = "pipeline") -> DataFrame:
    """All rows, those without a status (none), or those with the given one."""
    if choice == "All":
        return rows
    return rows.where(text(column) == ("" if choice == "none" else choice))


def with_outreach(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    one = statuses.groupBy("user_id", "permit_id").agg(F.max("outreach").alias("outreach"))
    return rows.join(one, ["user_id", "permit_id"], "left").withColumn("outreach", text("outreach"))


def leads_filter(rows: DataFrame, choice: str = "All", keyword: str = "") -> DataFrame:
    k = keyword.strip().lower()
    kept = pipeline_filter(rows, choice, "outreach")
    return kept.where(F.contains(blob("address", "description", "contractor_name", "city"), F.lit(k))) if k else kept


def feed_stats(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """Total, open, towns and saved rows per user."""
    counts = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(relevance.is_exactly_open("status")).alias("open_now"))
    towns = rows.select("user_id", "city").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("towns"))
    stars = saved.groupBy("user_id").agg(F.count(F.lit(1)).alias("saved"))
    return counts.join(towns, "user_id").join(stars, "user_id", "left").withColumn("saved", F.coalesce("saved", F.lit(0)))


def city_tiles(rows: DataFrame) -> DataFrame:
    """Rows per town and user, with the user's total under All."""
    per = rows.groupBy("user_id", "city").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("user_id").agg(F.sum("n").alias("n")).select("user_id", F.lit("All").alias("city"), "n")
    return per.unionByName(total)


def pipeline_stats(saved: DataFrame) -> DataFrame:
    """Counts by pipeline status, tracked and won money and win rate per user."""
    status, value = F.col("pipeline"), money.parse_value("value")
    def n(s: str) -> Column:
        return F.count_if(text(status) == s)
    rows = saved.withColumn("_v", value)
    out = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("all_n"), n("").alias("none_n"), n("submitted").alias("submitted"), n("won").alias("won"),
        n("lost").alias("lost"), n("passed").alias("passed"),
        F.coalesce(F.sum(F.when((F.col("_v") >= 0) & (text(status) == "won"), F.col("_v"))), F.lit(0.0)).alias("won_value"),
        F.coalesce(F.sum(F.when(F.col("_v") >= 0, F.col("_v"))), F.lit(0.0)).alias("tracked_value"))
    decided = F.col("won") + F.col("lost")
    rate = F.bround((F.col("won") * 100).cast("decimal(20,6)") / decided, 0).cast("int").cast("string")
    return out.withColumn("win_rate", F.when(decided > 0, F.concat(rate, F.lit("%"))).otherwise(F.lit("—")))


def lead_status_tiles(rows: DataFrame) -> DataFrame:
    return tally(rows, "user_id", first_filled("outreach", F.lit("none")).alias("status"))


def feed_sort(rows: DataFrame, mode: str, as_of: Column, saved: DataFrame | None = None) -> DataFrame:
    """Each user's feed with its order as ``place``: by best match, deadline, or value with user edits."""
    if mode == "Deadline":
        keyed = rows.withColumn("sort_key", F.coalesce(dates.days_until("deadline", as_of), F.lit(9999)).cast("double"))
    elif mode == "Est. Value":
        edited = saved_overrides(rows, saved, ["value"]) if saved is not None else rows
        keyed = edited.withColumn("sort_key", -money.parse_value("value"))
    else:
        keyed = rows.withColumn("sort_key", F.col("rank").cast("double"))
    return placed(keyed, "sort_key", "rank")


def placed(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))


def open_first(rows: DataFrame) -> DataFrame:
    section = F.when(relevance.is_exactly_open("status"), F.lit("open")).otherwise(F.lit("other"))
    return placed(rows.withColumn("section", section), "section", "rank")


def leads_newest(rows: DataFrame) -> DataFrame:
    return placed(rows, F.desc(text("issued_date")), "seq")


def saved_overrides(rows: DataFrame, saved: DataFrame, fields: list[str]) -> DataFrame:
    """Fields as the user edited them, where the edit is not blank."""
    edits = saved.select("user_id", "bid_key", *[F.col(f).alias(f"_s_{f}") for f in fields])
    joined = rows.join(edits, ["user_id", "bid_key"], "left")
    return joined.select(*[F.coalesce(filled(f"_s_{c}"), text(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def merge_saved(cloud: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged rows, rows to push): the cloud wins, rows only known locally are kept and pushed."""
    push = subtract_keys(local, cloud, ["user_id", "bid_key"])
    return cloud.unionByName(push, allowMissingColumns=True), push


def merge_feed(have: DataFrame, fresh: DataFrame, id_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged feed, added rows): only rows whose id is new for that user and town."""
    added = insert_missing(have, fresh, ["user_id", "city", *id_columns], [F.col("seq")])
    return have.unionByName(added, allowMissingColumns=True), added


def with_bid_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bid_key", keys.bid_id("city", "title", "scope"))


# ---- exports ------------------------------------------------------------------------
def bids_export(rows: DataFrame) -> DataFrame:
    names = {"City": "city", "Title": "title", "Status": "status", "Scope": "scope", "Est. Value": "value",
             "Deadline": "deadline", "Contact": "contact", "Email": "email", "Phone": "phone", "Link": "url"}
    return rows.select(*[text(c).alias(n) for n, c in names.items()])


def saved_export(rows: DataFrame, choice: str = "All") -> DataFrame:
    names = {"City": "city", "Title": "title", "Scope": "scope", "Est. Value": "value", "Deadline": "deadline",
             "Contact": "contact", "Email": "email", "Phone": "phone", "Source URL": "url", "Pipeline Status": "pipeline"}
    return pipeline_filter(rows, choice).select(*[text(c).alias(n) for n, c in names.items()])


def leads_export(rows: DataFrame) -> DataFrame:
    names = {"City": "city", "Address": "address", "Permit Type": "permit_type", "Description": "description",
             "Issued Date": "issued_date", "Lead Type": "lead_type_label", "Builder/Contact": "contractor_name",
             "Trade": "contractor_trade", "Phone": "contractor_phone", "Permit Record": "url", "Status": "outreach"}
    have = rows if "lead_type_label" in rows.columns else leads.with_lead_type(rows)
    return have.select(*[(text(c) if c in have.columns else F.lit("")).alias(n) for n, c in names.items()])


def map_points(centres: DataFrame, towns: DataFrame, bid_counts: DataFrame) -> DataFrame:
    """Centre and towns of each search with colour and label by outcome; unplaced towns dropped."""
    name = F.concat_ws(", ", "name", "state")
    n = F.coalesce("n_bids", F.lit(0))
    skipped = F.col("status") == "skipped"
    label = (F.when(skipped, F.concat(name, F.lit(" — no bid page auto-found")))
             .when(n > 0, F.concat(name, F.lit(" — "), n.cast("string"), F.lit(" bid(s) found")))
             .otherwise(F.concat(name, F.lit(" — scanned, no open bids"))))
    colour = F.when(skipped, F.lit("#9aa0a6")).when(n > 0, F.lit("#34a853")).otherwise(F.lit("#4a90e2"))
    quiet = lambda c: F.replace(c, F.lit('"'), F.lit("'"))
    spots = (towns.where("lat is not null and lon is not null").join(bid_counts, ["search_id", "name"], "left")
             .select("search_id", "lat", "lon", quiet(label).alias("label"), colour.alias("color"), F.lit(7).alias("radius")))
    middle = centres.select("search_id", "lat", "lon", quiet(F.concat(F.lit("Search center: "), "label")).alias("label"),
                            F.lit("#f5b400").alias("color"), F.lit(9).alias("radius"))
    return middle.unionByName(spots)
