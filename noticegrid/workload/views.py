"""Domain tables derived from the star-schema test tables, once in Spark and once in SQL.

Each view is a fixed expression over whole tables. ``sql(names, body)`` prefixes a query with
the common table expressions it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2006-08-01 12:00:00"
EVENTS_AS_OF = "2024-02-01 00:00:00"
STATES = ["AL", "AR", "AZ", "CA", "CO", "FL", "GA", "IA", "IL", "IN", "KS", "KY", "LA", "MD", "MI", "MN", "MO",
          "NC", "NE", "NM", "OH", "OK", "PA", "TN", "TX"]
SYLLABLES = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu"]
TRADES = ["Sidewalk replacement", "ADA ramp", "Curb and gutter", "Janitorial services", "Landscaping and sidewalk",
          "Software audit", "Roadway resurfacing", "Office supply", "Concrete flatwork", "Nevada lease", "",
          "Public works infrastructure"]
RADII = [25, 50, 75, 125]
LEAD_TRADES = ["General Contractor", "", "Concrete Paving", "Plumbing", "Home Builder"]


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def events_as_of() -> Column:
    return F.lit(EVENTS_AS_OF).cast("timestamp")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_pick(values: list, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"(list_value({items}))[CAST({index} AS INTEGER) + 1]"


def town_name(key: Column) -> Column:
    out = key.cast("string")
    for digit, syllable in enumerate(SYLLABLES):
        out = F.replace(out, F.lit(str(digit)), F.lit(syllable))
    return F.concat(F.lit("Ka"), out)


def sql_town_name(key: str) -> str:
    out = f"CAST({key} AS VARCHAR)"
    for digit, syllable in enumerate(SYLLABLES):
        out = f"replace({out}, '{digit}', '{syllable}')"
    return f"('Ka' || {out})"


def latitude(key: Column) -> Column:
    return F.lit(25.0) + F.pmod(key * 7919, F.lit(24000)).cast("double") / 1000


def longitude(key: Column) -> Column:
    return F.lit(-124.0) + F.pmod(key * 104729, F.lit(57000)).cast("double") / 1000


def sql_lat(key: str) -> str:
    return f"(CAST(25 AS DOUBLE) + CAST(({key} * 7919) % 24000 AS DOUBLE) / 1000)"


def sql_lon(key: str) -> str:
    return f"(CAST(-124 AS DOUBLE) + CAST(({key} * 104729) % 57000 AS DOUBLE) / 1000)"


def sql_distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2 * 3958.8 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


class Views:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def towns(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            town_name(k).alias("city"), pick(STATES, F.col("c_nationkey")).alias("state"),
            latitude(k).alias("lat"), longitude(k).alias("lon"), k.alias("town_id"))

    def gazetteer(self) -> DataFrame:
        """Towns known to the gazetteer: every customer but those with key % 50 = 49."""
        return self.towns().where("town_id % 50 <> 49").select("city", "state", "lat", "lon")

    def searches(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("search_id"), F.concat(F.lit("u"), F.pmod(k, F.lit(40)).cast("string")).alias("user_id"),
            town_name(k).alias("city"), pick(STATES, F.col("s_nationkey")).alias("state"),
            latitude(k).alias("lat"), longitude(k).alias("lon"), pick(RADII, k % 4).alias("radius"))

    def registry(self) -> DataFrame:
        """Registered domains: kind by key; every second county sits in another state."""
        k, name = F.col("c_custkey"), town_name(F.col("c_custkey"))
        kind = k % 4
        org = (F.when(kind == 0, F.concat(F.lit("City of "), name)).when(kind == 1, F.concat(name, F.lit(" County")))
               .when(kind == 2, F.concat(name, F.lit(" Water District"))).otherwise(F.concat(name, F.lit(" School District"))))
        moved = F.when(k % 8 == 1, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
        return self.table("customer").select(
            F.concat(F.lower(name), F.lit(".gov")).alias("domain"),
            pick(["City", "County", "Special district", "School district"], kind).alias("type"), org.alias("org"),
            name.alias("city"), pick(STATES, moved).alias("state"))

    def bids(self) -> DataFrame:
        k = F.col("o_orderkey")
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
            self.table("part").select("p_partkey", "p_name", "p_type"), F.col("o_custkey") == F.col("p_partkey"))
        joined = joined.withColumns({"_name": town_name(F.col("c_custkey")), "_state": pick(STATES, F.col("c_nationkey")),
                                     "_due": F.add_months(F.date_trunc("quarter", "o_orderdate"), 96)})
        name, state, d = F.col("_name"), F.col("_state"), F.col("_due")
        due = (F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.concat(F.lit("FY"), F.date_format(d, "yyyy")))
               .when(k % 17 == 0, F.lit("in 8 days"))
               .when(F.col("o_custkey") % 5 == 0, F.date_format(d, "yyyy-MM-dd"))
               .when(F.col("o_custkey") % 5 == 1, F.date_format(d, "MM/dd/yyyy"))
               .when(F.col("o_custkey") % 5 == 2, F.concat(F.lit("Due by "), F.date_format(d, "M/d/yyyy"), F.lit(" at 2:00 PM CST")))
               .when(F.col("o_custkey") % 5 == 3, F.date_format(d, "MMMM d, yyyy"))
               .otherwise(F.concat(F.lit("Bids due "), F.date_format(d, "MMM. d yyyy"))))
        where = k % 20
        city = (F.when(where.isin(0, 6), F.lit("")).when(where == 1, F.concat(name, F.lit(", "), state))
                .when(where == 2, F.concat(F.lit("City of "), name))
                .when(where == 3, F.expr("left(_name, length(_name) - 1)"))
                .when(where == 4, F.concat(name, F.lit(" County"))).when(where == 5, F.lit("Nowhere")).otherwise(name))
        price = F.floor("o_totalprice").cast("bigint")
        text_key = k.cast("string")
        return joined.select(
            k.alias("bid_id"), k.alias("seq"),
            F.trim(F.concat(pick(TRADES, k % 12), F.when(k % 12 == 10, F.lit("")).otherwise(
                F.concat(F.lit(" "), F.col("p_name"), F.lit(" "), F.lower("p_type"))))).alias("title"),
            F.when(k % 3 == 0, F.lit("Remove and replace ADA ramp")).when(k % 3 == 1, F.lit("Plan year 2004 work"))
            .otherwise(F.lit("")).alias("scope"),
            F.when(F.col("o_orderstatus") == "O", F.lit("Open")).when(F.col("o_orderstatus") == "F", F.lit("Closed"))
            .otherwise(pick(["Accepting Bids", "", "Awarded to Acme", "Award"], k % 4)).alias("status"),
            due.alias("deadline"), F.when(k % 9 == 0, F.lit("Marla Whitfield")).otherwise(F.lit("")).alias("contact"),
            F.when(k % 4 == 0, F.concat(F.lit("buyer"), text_key, F.lit("@"), F.lower(name), F.lit(".gov"))).otherwise(F.lit("")).alias("email"),
            F.when(k % 5 == 0, F.concat(F.lit("(417) 555-"), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise(F.lit("")).alias("phone"),
            F.when(k % 3 == 0, F.concat(F.lit("$"), price.cast("string")))
            .when(k % 3 == 1, F.concat(F.lit("$"), F.floor(price / 1000).cast("string"), F.lit("k"))).otherwise(F.lit("")).alias("value"),
            F.concat(F.lit("https://"), F.lower(name), F.lit(".gov/bids/"), text_key).alias("url"), city.alias("city"),
            F.when(k % 22 == 0, F.date_format(F.add_months("o_orderdate", 96), "yyyy-MM-dd")).otherwise(F.lit("")).alias("published"),
            F.when(where == 6, F.lit("")).otherwise(name).alias("default_city"),
            F.when(where == 7, F.lit("")).otherwise(state).alias("default_state"), state.alias("center_state"),
            F.when(where != 8, latitude(F.col("c_custkey"))).alias("fallback_lat"),
            F.when(where != 8, longitude(F.col("c_custkey"))).alias("fallback_lon"),
            name.alias("town"), state.alias("town_state"))

    def plain_bids(self) -> DataFrame:
        return self.bids().select("bid_id", "seq", "title", "scope", "status", "deadline", "contact", "email", "phone",
                                  "value", "url", "town", "town_state")

    def fetch_log(self) -> DataFrame:
        """Fetch results of portals; a fifth of the events are failures."""
        return self.table("events").select(
            F.col("user_id").alias("portal"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
            (F.col("event_type") != "error").alias("ok"),
            F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, F.lit(429)).otherwise(F.lit(500)))
            .otherwise(F.lit(200)).alias("status"), F.col("event_type"))

    def portals(self) -> DataFrame:
        """One stored page per town, failing by key."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            F.concat(F.lower(town_name(k)), F.lit("|"), pick(STATES, F.col("c_nationkey"))).alias("city_key"),
            F.concat(F.lit("https://"), F.lower(town_name(k)), F.lit(".gov/"),
                     F.when(k % 3 == 0, F.lit("Bids.aspx")).otherwise(F.lit("purchasing"))).alias("url"),
            F.when(k % 3 == 0, F.lit("civicplus")).otherwise(F.lit("agency")).alias("platform"),
            pick(["learned", "seed", "national_crawl", "wikidata"], k % 4).alias("source"),
            F.lit("2024-01-01").cast("date").alias("added"), F.lit(None).cast("date").alias("last_ok"),
            F.lit(None).cast("date").alias("last_checked"), (k % 7).cast("int").alias("fail_count"))

    def crawl(self) -> DataFrame:
        """Crawl outcome per registered domain; about a third found."""
        k = F.col("c_custkey")
        name = town_name(k)
        return self.table("customer").select(
            F.concat(F.when(k % 5 == 0, F.lit("www.")).otherwise(F.lit("")), F.lower(name), F.lit(".gov")).alias("domain"),
            name.alias("city"), pick(STATES, F.col("c_nationkey")).alias("state"),
            pick(["City", "County", "Special district", "School district"], k % 4).alias("type"),
            F.when(k % 3 == 0, F.lit("found")).otherwise(F.lit("not_found")).alias("status"),
            F.when(k % 3 == 0, F.concat(F.lit("https://"), F.lower(name), F.lit(".gov/Bids.aspx"))).otherwise(F.lit("")).alias("bid_url"),
            F.when(k % 6 == 0, F.lit("civicplus")).otherwise(F.lit("")).alias("platform"), (k % 2).alias("file_ord"), k.alias("row_ord"))

    def listing_pages(self) -> DataFrame:
        """Listing pages of eight bids each, with a 'Read on' link and labelled values per posting."""
        k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
        title = F.concat(pick(TRADES, k % 12), F.lit(" job "), key)
        status = F.when(F.col("o_orderstatus") == "O", F.lit("Open")).when(F.col("o_orderstatus") == "F", F.lit("Closed")).otherwise(F.lit("Awarded"))
        link = F.concat(F.lit('<a href="bids.aspx?bidID='), key, F.lit('">'))
        post = F.concat(
            F.lit("<div><span>"), link, title, F.lit("</a></span><br><span><b>Bid No.</b> 0"), key,
            # every fortieth posting says at length what it is about before it states status and date
            F.lit("</span><p>Summary of the work &amp; more "), F.when(k % 40 == 0, F.repeat(F.lit("as laid out in the plans, "), 400)).otherwise(F.lit("")), F.lit("... ["), link, F.lit("Read on</a>]</p><span>Status:</span><br><span>Closes:</span> <span>"),
            status, F.lit("</span><br><span>"),
            F.when(k % 6 != 0, F.date_format(F.add_months("o_orderdate", 96), "M/d/yyyy")).otherwise(F.lit("TBA")), F.lit("</span></div>\n"))
        page = F.floor(k / 8)
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), post.alias("p")))), lambda x: x["p"]), "")
        return self.table("orders").groupBy(page.alias("page_id")).agg(body.alias("_b")).select(
            "page_id", F.concat(F.lit("https://t"), F.col("page_id").cast("string"), F.lit(".gov/Bids.aspx")).alias("url"),
            F.concat(F.lit("<html><body><h1>Bid Postings</h1>"), F.col("_b"), F.lit("</body></html>")).alias("html"))

    def detail_pages(self) -> DataFrame:
        """One posting page per bid; which fields it states follows from the key."""
        k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
        day = F.date_format(F.add_months("o_orderdate", 96), "M/d/yyyy")
        part = lambda every, rest, c: F.when(k % every == rest, c).otherwise(F.lit(""))
        html = F.concat(
            F.lit("<html><title>Job</title><p>Description: Replace and repair the public way along Main Street, phase "), key, F.lit("</p><p>"),
            part(2, 0, F.lit("Contact: Marla Whitfield Email: ")), part(2, 1, F.lit("Contact: ")),
            part(3, 0, F.concat(F.lit("clerk"), key, F.lit("@town.gov"))), F.lit(" webmaster@town.gov</p>"),
            part(5, 0, F.concat(F.lit("<p>Phone 417.864."), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("</p>"))),
            part(4, 1, F.concat(F.lit("<p>Closing Date/Time:&nbsp;"), day, F.lit(" 2:00 PM</p>"))),
            part(7, 2, F.concat(F.lit("<p>Engineer&#39;s estimate: $"), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit("</p>"))),
            part(3, 1, F.concat(F.lit("<p>Publication Date: "), day, F.lit("</p>"))),
            part(3, 2, F.concat(F.lit("<p>Bid Number: A-"), key, F.lit(" </p>"))),
            part(6, 0, F.lit("<p>A mandatory pre-bid meeting will be held.</p>")), part(6, 1, F.lit("<p>Pre-bid conference at town hall.</p>")),
            part(9, 4, F.lit("<p>Addendum 1 issued.</p>")),
            part(4, 0, F.concat(F.lit('<a href="/DocumentCenter/View/'), key, F.lit('">plans</a><a href="plan.pdf">p</a><a href="plan.pdf">p</a>'))),
            F.lit("</html>"))
        return self.table("orders").select(k.alias("bid_id"), F.concat(F.lit("https://d.gov/bids/"), key).alias("url"), html.alias("html"))

    def leads(self) -> DataFrame:
        """Permits as leads; the trade follows the order priority."""
        k = F.col("o_orderkey")
        prio = F.substring("o_orderpriority", 1, 1).cast("int") - 1
        return self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
            F.concat(F.lit("P"), k.cast("string")).alias("permit_id"), k.alias("seq"),
            F.concat((k % 900).cast("string"), F.lit(" Main St")).alias("address"), town_name(F.col("o_custkey")).alias("city"),
            pick(STATES, F.col("c_nationkey")).alias("state"),
            F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0").alias("zip"),
            F.lit("Driveway").alias("permit_type"), F.concat(F.lit("Driveway work "), (k % 50).cast("string")).alias("description"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued_date"),
            F.when(k % 2 == 0, F.concat(F.lit("Firm "), (k % 70).cast("string"))).otherwise(F.lit("")).alias("contractor_name"),
            pick(LEAD_TRADES, prio).alias("contractor_trade"),
            F.when(k % 3 == 0, latitude(F.col("o_custkey"))).alias("lat"), F.when(k % 3 == 0, longitude(F.col("o_custkey"))).alias("lon"),
            pick(["", "called", "quoted", "won", "lost"], k % 5).alias("outreach"))


_NAME = sql_town_name("c_custkey")
_STATE = sql_pick(STATES, "c_nationkey")
_D = "(date_trunc('quarter', o_orderdate) + INTERVAL 8 YEAR)"

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "towns": ((), f"SELECT {_NAME} AS city, {_STATE} AS state, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon, "
                  "c_custkey AS town_id FROM customer"),
    "gazetteer": (("towns",), "SELECT city, state, lat, lon FROM towns WHERE town_id % 50 <> 49"),
    "searches": ((), f"SELECT s_suppkey AS search_id, 'u' || CAST(s_suppkey % 40 AS VARCHAR) AS user_id, "
                     f"{sql_town_name('s_suppkey')} AS city, {sql_pick(STATES, 's_nationkey')} AS state, {sql_lat('s_suppkey')} AS lat, "
                     f"{sql_lon('s_suppkey')} AS lon, {sql_pick(RADII, 's_suppkey % 4')} AS radius FROM supplier"),
    "registry": ((), f"""SELECT lower({_NAME}) || '.gov' AS domain,
        {sql_pick(['City', 'County', 'Special district', 'School district'], 'c_custkey % 4')} AS type,
        CASE c_custkey % 4 WHEN 0 THEN 'City of ' || {_NAME} WHEN 1 THEN {_NAME} || ' County'
             WHEN 2 THEN {_NAME} || ' Water District' ELSE {_NAME} || ' School District' END AS org, {_NAME} AS city,
        {sql_pick(STATES, 'CASE WHEN c_custkey % 8 = 1 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END')} AS state FROM customer"""),
    "bids": ((), f"""SELECT o_orderkey AS bid_id, o_orderkey AS seq,
        trim({sql_pick(TRADES, 'o_orderkey % 12')} || CASE WHEN o_orderkey % 12 = 10 THEN '' ELSE ' ' || p_name || ' ' || lower(p_type) END) AS title,
        CASE o_orderkey % 3 WHEN 0 THEN 'Remove and replace ADA ramp' WHEN 1 THEN 'Plan year 2004 work' ELSE '' END AS scope,
        CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' ELSE {sql_pick(['Accepting Bids', '', 'Awarded to Acme', 'Award'], 'o_orderkey % 4')} END AS status,
        CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'FY' || strftime({_D}, '%Y')
             WHEN o_orderkey % 17 = 0 THEN 'in 8 days' WHEN o_custkey % 5 = 0 THEN strftime({_D}, '%Y-%m-%d')
             WHEN o_custkey % 5 = 1 THEN strftime({_D}, '%m/%d/%Y')
             WHEN o_custkey % 5 = 2 THEN 'Due by ' || strftime({_D}, '%-m/%-d/%Y') || ' at 2:00 PM CST'
             WHEN o_custkey % 5 = 3 THEN strftime({_D}, '%B %-d, %Y') ELSE 'Bids due ' || strftime({_D}, '%b. %-d %Y') END AS deadline,
        CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL ELSE CAST({_D} AS DATE) END AS due_date,
        CASE WHEN o_orderkey % 9 = 0 THEN 'Marla Whitfield' ELSE '' END AS contact,
        CASE WHEN o_orderkey % 4 = 0 THEN 'buyer' || CAST(o_orderkey AS VARCHAR) || '@' || lower({_NAME}) || '.gov' ELSE '' END AS email,
        CASE WHEN o_orderkey % 5 = 0 THEN '(417) 555-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') ELSE '' END AS phone,
        CASE o_orderkey % 3 WHEN 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
             WHEN 1 THEN '$' || CAST(CAST(floor(floor(o_totalprice) / 1000) AS BIGINT) AS VARCHAR) || 'k' ELSE '' END AS value,
        'https://' || lower({_NAME}) || '.gov/bids/' || CAST(o_orderkey AS VARCHAR) AS url,
        CASE WHEN o_orderkey % 20 IN (0, 6) THEN '' WHEN o_orderkey % 20 = 1 THEN {_NAME} || ', ' || {_STATE}
             WHEN o_orderkey % 20 = 2 THEN 'City of ' || {_NAME} WHEN o_orderkey % 20 = 3 THEN {_NAME}[:-2]
             WHEN o_orderkey % 20 = 4 THEN {_NAME} || ' County' WHEN o_orderkey % 20 = 5 THEN 'Nowhere' ELSE {_NAME} END AS city,
        CASE WHEN o_orderkey % 22 = 0 THEN strftime(o_orderdate + INTERVAL 8 YEAR, '%Y-%m-%d') ELSE '' END AS published,
        CASE WHEN o_orderkey % 20 = 6 THEN '' ELSE {_NAME} END AS default_city,
        CASE WHEN o_orderkey % 20 = 7 THEN '' ELSE {_STATE} END AS default_state, {_STATE} AS center_state,
        CASE WHEN o_orderkey % 20 <> 8 THEN {sql_lat('c_custkey')} END AS fallback_lat,
        CASE WHEN o_orderkey % 20 <> 8 THEN {sql_lon('c_custkey')} END AS fallback_lon,
        {_NAME} AS town, {_STATE} AS town_state, c_custkey AS town_id, c_nationkey AS nationkey, CAST(o_orderdate AS DATE) AS order_day
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON o_custkey = p_partkey"""),
    "judged": (("bids",), """SELECT *, CASE
          WHEN due_date IS NOT NULL THEN CASE
               WHEN contains(deadline, '2:00 PM CST') THEN CASE WHEN CAST(due_date AS TIMESTAMP) + INTERVAL 20 HOUR < TIMESTAMP '2006-08-01 12:00:00' THEN 'Closed' ELSE status END
               WHEN due_date < DATE '2006-08-01' THEN 'Closed' ELSE status END
          WHEN starts_with(deadline, 'FY') AND CAST(substr(deadline, 3, 4) AS INTEGER) >= 2000 AND CAST(substr(deadline, 3, 4) AS INTEGER) < 2006 THEN 'Closed'
          ELSE status END AS status_now FROM bids"""),
    "fetch_log": ((), """SELECT user_id AS portal, ts, event_id AS seq, event_type <> 'error' AS ok,
        CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 429 ELSE 500 END ELSE 200 END AS status, event_type FROM events"""),
    "portals": ((), f"""SELECT lower({_NAME}) || '|' || {_STATE} AS city_key,
        'https://' || lower({_NAME}) || '.gov/' || CASE WHEN c_custkey % 3 = 0 THEN 'Bids.aspx' ELSE 'purchasing' END AS url,
        CASE WHEN c_custkey % 3 = 0 THEN 'civicplus' ELSE 'agency' END AS platform,
        {sql_pick(['learned', 'seed', 'national_crawl', 'wikidata'], 'c_custkey % 4')} AS source, DATE '2024-01-01' AS added,
        CAST(NULL AS DATE) AS last_ok, CAST(NULL AS DATE) AS last_checked, CAST(c_custkey % 7 AS INTEGER) AS fail_count FROM customer"""),
    "crawl": ((), f"""SELECT CASE WHEN c_custkey % 5 = 0 THEN 'www.' ELSE '' END || lower({_NAME}) || '.gov' AS domain, {_NAME} AS city,
        {_STATE} AS state, {sql_pick(['City', 'County', 'Special district', 'School district'], 'c_custkey % 4')} AS type,
        CASE WHEN c_custkey % 3 = 0 THEN 'found' ELSE 'not_found' END AS status,
        CASE WHEN c_custkey % 3 = 0 THEN 'https://' || lower({_NAME}) || '.gov/Bids.aspx' ELSE '' END AS bid_url,
        CASE WHEN c_custkey % 6 = 0 THEN 'civicplus' ELSE '' END AS platform, c_custkey % 2 AS file_ord, c_custkey AS row_ord FROM customer"""),
    "leads": ((), f"""SELECT 'P' || CAST(o_orderkey AS VARCHAR) AS permit_id, o_orderkey AS seq,
        CAST(o_orderkey % 900 AS VARCHAR) || ' Main St' AS address, {_NAME} AS city, {_STATE} AS state,
        lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS zip, 'Driveway' AS permit_type,
        'Driveway work ' || CAST(o_orderkey % 50 AS VARCHAR) AS description, strftime(o_orderdate, '%Y-%m-%d') AS issued_date,
        CASE WHEN o_orderkey % 2 = 0 THEN 'Firm ' || CAST(o_orderkey % 70 AS VARCHAR) ELSE '' END AS contractor_name,
        {sql_pick(LEAD_TRADES, "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1")} AS contractor_trade,
        CASE WHEN o_orderkey % 3 = 0 THEN {sql_lat('o_custkey')} END AS lat, CASE WHEN o_orderkey % 3 = 0 THEN {sql_lon('o_custkey')} END AS lon,
        {sql_pick(['', 'called', 'quoted', 'won', 'lost'], 'o_orderkey % 5')} AS outreach,
        CASE WHEN {sql_pick(LEAD_TRADES, "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1")} = '' THEN 'open'
             ELSE {sql_pick(['builder', 'open', 'taken', 'unknown', 'builder'], "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1")} END AS lead_type
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
}


def sql(names: str, body: str, **extra: str) -> str:
    """Query text with the views it names, in dependency order, as common table expressions."""
    done: list[str] = []

    def visit(name: str) -> None:
        for need in SQL[name][0]:
            visit(need)
        if name not in done:
            done.append(name)

    for name in names.split():
        visit(name)
    ctes = [f"{n} AS MATERIALIZED ({SQL[n][1]})" for n in done] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
