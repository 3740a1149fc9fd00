"""Bid rows: sources to one schema, duplicates, enrichment, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import dates, keys, places, posting, relevance
from noticegrid.functions.text import filled, first_filled, strip, text, visible
from noticegrid.operators.common import first_per_key, ranked_rows, top_k

BID_FIELDS = ["title", "scope", "status", "deadline", "contact", "email", "phone", "value", "url", "city"]
DETAIL_FIELDS = ["contact", "email", "phone", "deadline", "scope", "value", "published", "bid_number", "prebid"]


def federal_to_bids(federal: DataFrame, as_of: Column) -> DataFrame:
    """Federal notices as bids: first contact, joined scope, a link that can be opened."""
    poc = F.get("pointOfContact", 0)
    notice = F.trim(text("noticeId"))
    link = F.when(notice.rlike("^[0-9a-fA-F]{8,}$"), F.concat(F.lit("https://sam.gov/opp/"), notice, F.lit("/view")))
    active = F.lower(F.trim(text("active"))) == "yes"
    deadline = F.substring(text("responseDeadLine"), 1, 10)
    status = F.when(active, F.lit("Open")).otherwise(F.lit("Closed"))
    return federal.select(
        "noticeId", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled Opportunity")).alias("title"),
        F.concat_ws(" · ", F.lit("Federal"), F.nullif(F.col("type"), F.lit("")),
                    F.nullif(first_filled("fullParentPathName", "organizationName"), F.lit(""))).alias("scope"),
        dates.deadline_status(status, deadline, as_of).alias("status"), deadline.alias("deadline"),
        text(poc["fullName"]).alias("contact"), text(poc["email"]).alias("email"), text(poc["phone"]).alias("phone"),
        F.lit("").alias("value"), F.coalesce(F.nullif(F.col("uiLink"), F.lit("")), link, F.lit("")).alias("url"),
        text(F.col("placeOfPerformance.city.name")).alias("city"),
        F.upper(text(F.col("placeOfPerformance.state.code"))).alias("default_state"))


def agency_notices(raw: DataFrame) -> DataFrame:
    """Notices posted by agencies: trimmed, kept only with title, city and a real state.

    Texts are whole; ``over_length`` names the fields that are longer than the form allows.
    """
    sizes = {"title": 200, "scope": 2000, "city": 80, "deadline": 60, "contact": 120, "email": 160, "phone": 40,
             "url": 400, "agency": 160}
    extra = [c for c in raw.columns if c not in sizes and c not in ("state", "status", "source")]
    over = F.array_compact(F.array(*[F.when(F.length(F.trim(text(n))) > k, F.lit(n)) for n, k in sizes.items()]))
    return raw.select(*extra, *[F.trim(text(n)).alias(n) for n in sizes], over.alias("over_length"), places.state_code("state").alias("state"),
                      F.lit("Open").alias("status"), F.lit("agency_posted").alias("source")
                      ).where("title <> '' and city <> '' and state <> ''")


def approved_notices(notices: DataFrame) -> DataFrame:
    return notices.where("approved and lat is not null and lon is not null")


def normalize_opportunities(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All sources in one schema, tagged with source and the priority of its position."""
    out = None
    for priority, (name, rows) in enumerate(sources):
        tagged = rows.withColumn("source", F.lit(name)).withColumn("source_priority", F.lit(priority))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def dedupe_bids(rows: DataFrame, scope: Sequence[str], order: Sequence[str], row_id: str) -> DataFrame:
    """One row per (scope, title, deadline), the first by order; untitled rows are all kept."""
    keyed = (rows.withColumn("_title", keys.title_key("title")).withColumn("_due", keys.deadline_key("deadline"))
             .withColumn("_self", F.when(F.col("_title") == "", F.col(row_id).cast("string")).otherwise(F.lit(""))))
    return first_per_key(keyed, [*scope, "_title", "_due", "_self"], [F.col(c) for c in order]).drop(
        "_title", "_due", "_self")


def enrich_budget(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Bids per search worth reading further: a link but no way to call; undated ones first. The first ``limit`` on request."""
    todo = rows.where((text("url") != "") & (text("email") == "") & (text("phone") == ""))
    dated = F.when(F.trim(text("deadline")) == "", F.lit(0)).otherwise(F.lit(1))
    return ranked_rows(todo, ["search_id"], [dated, F.col("seq")], limit, "read_order")


def with_details(rows: DataFrame, details: DataFrame, only: Column | None = None) -> DataFrame:
    """Rows plus e_ columns: each field as it stands, or from the posting page where empty."""
    d = details.select("url", F.lit(True).alias("_read"), *[F.col(c).alias(f"_d_{c}") for c in DETAIL_FIELDS],
                       F.col("addenda").alias("_d_addenda"), F.col("documents").alias("_d_documents"))
    may = F.col("_read").isNotNull() if only is None else F.col("_read").isNotNull() & only
    joined = rows.join(d, "url", "left")

    def own(c: str) -> Column:
        return F.col(c) if c in rows.columns else F.lit(None)

    fields = {c: F.coalesce(filled(own(c)), F.when(may, filled(f"_d_{c}")), F.lit("")) for c in DETAIL_FIELDS}
    fields["addenda"] = F.coalesce(own("addenda").cast("boolean"), F.lit(False)) | F.coalesce(
        may & F.col("_d_addenda"), F.lit(False))
    documents = own("documents").cast("array<string>")
    fields["documents"] = F.coalesce(F.when(F.size(documents) > 0, documents), F.when(may, F.col("_d_documents")),
                                     F.array().cast("array<string>"))
    return joined.select(*rows.columns, *[v.alias(f"e_{c}") for c, v in fields.items()], F.col("_read").isNotNull().alias("was_read"))


def enrich_from_details(rows: DataFrame, details: DataFrame, only: Column | None = None) -> DataFrame:
    """Empty fields filled from the posting page with the same url; filled ones stay."""
    rich = with_details(rows, details, only)
    fields = [*DETAIL_FIELDS, "addenda", "documents"]
    return rich.select(*[c for c in rows.columns if c not in fields], *[F.col(f"e_{c}").alias(c) for c in fields])


def details_from_pages(pages: DataFrame) -> DataFrame:
    """Posting pages to the fields a bid row can take from them."""
    seen = pages.where(F.coalesce(F.col("outcome"), F.lit("ok")) == "ok") if "outcome" in pages.columns else pages
    t = seen.select("url", "html", visible("html").alias("_t"))
    return t.select(
        "url", posting.contact_name("_t").alias("contact"), posting.contact_email("_t").alias("email"),
        posting.contact_phone("_t").alias("phone"), dates.close_date("_t").alias("deadline"),
        posting.detail_scope("_t").alias("scope"), posting.detail_value("_t").alias("value"),
        posting.detail_published("_t").alias("published"), posting.detail_bid_number("_t").alias("bid_number"),
        posting.detail_prebid("_t").alias("prebid"), posting.detail_addenda("_t").alias("addenda"),
        posting.detail_documents("html", "url").alias("documents"))


def intake_reasons(rows: DataFrame) -> DataFrame:
    """What becomes of raw rows before they are placed, per source: malformed, off the trade, posted by an agency, or taken."""
    malformed = (strip("title") == "") & (strip("url") == "")
    posted = text("source") == "agency_posted"
    reason = (F.when(malformed, F.lit("malformed")).when(~posted & ~relevance.looks_relevant("title", "scope"), F.lit("filtered_not_niche"))
              .when(posted, F.lit("agency_posted")).otherwise(F.lit("taken")))
    return rows.groupBy("source", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def status_breakdown(rows: DataFrame, *by: str) -> DataFrame:
    label = first_filled(F.trim(text("status")), F.lit("(none)"))
    return rows.groupBy(*by, label.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def open_totals(rows: DataFrame, *by: str) -> DataFrame:
    is_open = relevance.is_open("status")
    return rows.groupBy(*by).agg(F.count_if(is_open).alias("open_total"), F.count_if(~is_open).alias("kept_closed"))


def scan_sample(rows: DataFrame, k: int = 8) -> DataFrame:
    """A handful of placed bids per search, by town."""
    return top_k(rows, ["search_id"], [F.col("label"), F.col("seq")], k).select(
        "search_id", F.col("label").alias("city"), text("title").alias("title"),
        text("deadline").alias("deadline"), text("status").alias("status"), relevance.is_open("status").alias("open"))


def rolling_history(scans: DataFrame, k: int | None = None) -> DataFrame:
    """Scans per area, newest first, with the slim columns only; the newest k on request."""
    slim = scans.select("at", "location", "radius", "kept", "raw_local", "anchor_towns", "funnel", "scan_id")
    return ranked_rows(slim, ["location"], [F.desc("at"), F.desc("scan_id")], k, "recency").drop("scan_id")
