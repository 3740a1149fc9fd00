"""State over time: the batch forms, and the streams that must end in the same state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noticegrid.functions import keys
from noticegrid.operators import health, radius
from noticegrid.session import checkpoint_root
from noticegrid.streaming import jobs
from noticegrid.workload import views as V
from noticegrid.workload.registry import register

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

_STREAK = """SELECT portal, CAST((SELECT count(*) FROM fetch_log g WHERE g.portal = f.portal AND NOT g.ok AND (any_ok IS NULL OR g.ts > any_ok)) AS INTEGER) AS fail_count, any_ok AS last_ok, last_checked
    FROM (SELECT portal, max(ts) FILTER (WHERE ok) AS any_ok, max(ts) AS last_checked FROM fetch_log GROUP BY portal) f"""


def root(v, name):
    return f"{checkpoint_root(v.spark)}/run-{name}-{uuid.uuid4().hex}"


BATCHES = 6


def in_batches(df, path, schema, key):
    """A table as a stream of shuffled files, one a micro-batch."""
    df.repartition(BATCHES, F.xxhash64(key)).write.parquet(path)
    return df.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_log(v, base):
    """The fetch log as a stream over the events table, in shuffled batches."""
    events = in_batches(v.table("events"), f"{base}/in", EVENTS, "event_id")
    kind = F.col("event_type") == "error"
    return events.select(F.col("user_id").alias("portal"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (~kind).alias("ok"),
                         F.when(kind, F.when(F.col("event_id") % 3 == 0, F.lit(429)).otherwise(F.lit(500))).otherwise(F.lit(200)).alias("status"), "event_type")


def state_of(v, make, name, variable=None):
    """Run a stream over the log and return the state it ends with."""
    base = root(v, name)
    jobs.start(make(stream_log(v, base)), name, base).awaitTermination()
    return jobs.current(v.spark, name, base, variable)


# Where the log is cut into what is stored already and what streams.
MIDDLE = "ts < timestamp '2024-01-16 00:00:00'"


@register("t3_portal_health", V.sql("fetch_log", "SELECT portal, fail_count, fail_count < 5 AS trusted FROM streak", streak=_STREAK))
def _(v):
    return health.portal_health(v.fetch_log()).select("portal", "fail_count", "trusted")


@register("t3_portal_health_stream", V.sql("fetch_log", "SELECT portal, fail_count, strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_ok FROM streak", streak=_STREAK))
def _(v):
    state = state_of(v, lambda log: jobs.streaks_stream(log, "portal", late="60 days"), "t3", "streak")
    return jobs.streaks(state, "portal").select("portal", "fail_count", F.date_format("last_ok", "yyyy-MM-dd HH:mm:ss").alias("last_ok"))


@register("t3_portal_health_resumed", V.sql("fetch_log", "SELECT portal, fail_count, strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_ok, strftime(last_checked, '%Y-%m-%d %H:%M:%S') AS last_checked FROM streak", streak=_STREAK))
def _(v):
    """The directory of the first half of the log, and the second half as a stream that goes on from it."""
    stored = health.portal_health(v.fetch_log().where(MIDDLE)).select("portal", "fail_count", "last_ok", "last_checked")
    state = state_of(v, lambda log: jobs.streaks_stream(log.where(f"not ({MIDDLE})"), "portal", late="60 days", stored=stored), "t3r", "streak")
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last_ok", "last_checked")]
    return jobs.streaks(state, "portal").select("portal", "fail_count", *shown)


_T4 = "SELECT portal, ts, event_id AS seq, event_id % 11 = 0 AS ok FROM (SELECT user_id % 20 AS portal, ts, event_id FROM events)"


@register("t4_search_degraded", V.sql("", "SELECT portal, (SELECT count(*) FROM hits g WHERE g.portal = f.portal AND NOT g.ok AND (f.k IS NULL OR g.ts > f.k)) AS empty_streak, (SELECT count(*) FROM hits g WHERE g.portal = f.portal AND NOT g.ok AND (f.k IS NULL OR g.ts > f.k)) >= 8 AS degraded FROM (SELECT portal, max(ts) FILTER (WHERE ok) AS k FROM hits GROUP BY portal) f", hits=_T4))
def _(v):
    log = v.fetch_log().withColumns({"portal": F.col("portal") % 20, "ok": F.col("seq") % 11 == 0})
    return health.search_degraded(log, ["portal"])


_T5 = f"SELECT portal, strftime(down, '%Y-%m-%d %H:%M:%S') AS down_until, coalesce({{0}} < down, FALSE) AS down FROM (SELECT portal, CASE WHEN arg_max(status, ts) = 429 THEN max(ts) + INTERVAL 300 SECOND END AS down FROM fetch_log WHERE ok OR status = 429 GROUP BY portal)"


@register("t5_provider_cooldown", V.sql("fetch_log", _T5.format("TIMESTAMP '2024-01-30 23:00:00'")))
def _(v):
    at = F.lit("2024-01-30 23:00:00").cast("timestamp")
    return health.provider_cooldown(v.fetch_log(), ["portal"], at).select("portal", F.date_format("down_until", "yyyy-MM-dd HH:mm:ss").alias("down_until"), "down")


@register("t5_provider_cooldown_stream", V.sql("fetch_log", f"SELECT portal, down_until FROM ({_T5.format(NOW)})"))
def _(v):
    state = state_of(v, lambda log: jobs.cooldown_stream(log, "portal"), "t5").toDF("portal", "last")
    return jobs.cooldown(state, "portal").select("portal", F.date_format("down_until", "yyyy-MM-dd HH:mm:ss").alias("down_until"))


_BENCH = """SELECT user_id AS portal, ts, event_type = 'error' AS refused, lead(ts) OVER w AS next_ts, lead(event_type) OVER w = 'error' AS next_refused, lag(ts) OVER w AS last_ts, lag(event_type) OVER w = 'error' AS last_refused
    FROM events WHERE event_type <> 'error' OR event_id % 3 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@register("t5_benches_stream", V.sql("", """SELECT portal, strftime(moment, '%Y-%m-%d %H:%M:%S') AS changed_at, down FROM (
    SELECT portal, ts AS moment, TRUE AS down FROM e WHERE refused AND NOT (coalesce(last_refused, FALSE) AND last_ts + INTERVAL 4 HOUR > ts)
    UNION ALL SELECT portal, CASE WHEN NOT next_refused AND next_ts < ts + INTERVAL 4 HOUR THEN next_ts ELSE ts + INTERVAL 4 HOUR END, FALSE FROM e
    WHERE refused AND NOT (coalesce(next_refused, FALSE) AND next_ts < ts + INTERVAL 4 HOUR))""", e=_BENCH))
def _(v):
    """Every change of every provider over the whole log, in shuffled batches; a tick from later moves the clock past the last bench."""
    base = root(v, "t5b")
    log = stream_log(v, base)
    run = lambda: jobs.start(jobs.benches_stream(log, "portal", seconds=4 * 3600, late="60 days"), "t5b", base, mode="append", path=f"{base}/out").awaitTermination()
    run()
    tick = v.spark.createDataFrame([(-1, "2024-08-01 00:00:00", -1, "tick", 0.0, "")], "event_id bigint, t string, user_id bigint, event_type string, value double, props string")
    tick.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").write.mode("append").parquet(f"{base}/in")
    run()
    told = v.spark.read.schema("portal bigint, changed_at timestamp, down boolean").parquet(f"{base}/out").where("portal >= 0")
    return told.select("portal", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss").alias("changed_at"), "down")


_T6 = "SELECT portal, count(*) FILTER (WHERE ok) AS ok_n, count(*) FILTER (WHERE NOT ok) AS failed_n, coalesce(arg_max(status, ts) FILTER (WHERE NOT ok), 0) AS last_status FROM fetch_log GROUP BY portal"


@register("t6_provider_health", V.sql("fetch_log", "SELECT *, last_status IN (401, 402, 403, 429, 432) AS quota_or_auth_failure, failed_n > 0 AND ok_n = 0 AS failing FROM h", h=_T6))
def _(v):
    return health.provider_health(v.fetch_log(), ["portal"])


@register("t6_provider_health_stream", V.sql("fetch_log", _T6))
def _(v):
    state = state_of(v, lambda log: jobs.health_stream(log, "portal"), "t6").toDF("portal", "ok_n", "n", "last")
    return jobs.health(state, "portal")


@register("t7_daily_rate_limit", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 10")
def _(v):
    posts = v.fetch_log().select(F.col("portal").alias("sender"), "ts", "seq")
    return health.daily_rate_limit(posts).select(F.col("seq").alias("event_id"))


@register("t7_daily_rate_limit_stream", "SELECT user_id AS portal, CAST(ts AS DATE) AS day, least(count(*), 10) AS accepted, greatest(count(*) - 10, 0) AS refused FROM events GROUP BY 1, 2")
def _(v):
    state = state_of(v, lambda log: jobs.rate_limit_stream(log, "portal", late="60 days"), "t7").toDF("portal", "window", "n")
    return jobs.rate_limit(state, "portal")


@register("t8_miss_retry", f"SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND (event_type = 'view' OR ts <= {NOW} - INTERVAL 24 HOUR)")
def _(v):
    cache = v.table("events").select("event_id", F.when(F.col("event_type").isin("view", "click"), F.lit(None)).otherwise(F.col("value")).cast("double").alias("lat"),
                                     F.when(F.col("event_type") == "click", F.col("ts").cast("timestamp")).alias("missed_at"))
    return health.miss_retry(cache, V.events_as_of()).select("event_id")


@register("t9_same_day_cache", V.sql("bids", "SELECT bid_id FROM bids WHERE bid_id % 3 <> 0 OR bid_id % 7 = 0"))
def _(v):
    import noticegrid.sources.sinks as sinks
    b = v.bids().select("bid_id", keys.scan_cache_key("town_state", F.concat("town", F.col("bid_id").cast("string")), F.lit(50), V.as_of()).alias("cache_key"), (F.col("bid_id") % 7 == 0).alias("force"))
    path = root(v, "t9")
    sinks.write_same_day(b.where("bid_id % 2 = 0").select("cache_key"), path, F.lit("2006-07-31").cast("timestamp"))
    sinks.write_same_day(b.where("bid_id % 3 = 0").select("cache_key"), path, V.as_of())
    return health.to_compute(b, v.spark.read.parquet(path), V.as_of()).select("bid_id")


_SIG = "SELECT 's' || user_id || '-' || event_type AS sig, CAST(ts AS DATE) AS d FROM events"
_CLOCK = "SELECT sig, min(d) AS first_seen FROM sightings GROUP BY sig"


def sightings(df):
    return df.select(F.concat(F.lit("s"), F.col("portal").cast("string"), F.lit("-"), "event_type").alias("sig"), F.col("ts").alias("seen"))


@register("t2_first_seen_clock", V.sql("", "SELECT sig, CASE WHEN sig LIKE '%-view' THEN least(first_seen, DATE '2023-12-01') ELSE first_seen END AS first_seen FROM clock", sightings=_SIG, clock=_CLOCK))
def _(v):
    seen = sightings(v.fetch_log())
    store = seen.select("sig", F.when(F.col("sig").endswith("-view"), F.lit("2023-12-01")).otherwise(F.lit("bad date")).alias("seen_date")).distinct()
    return health.first_seen_clock(seen, store)


@register("t2_first_seen_stream", V.sql("", "SELECT sig, CASE WHEN sig LIKE '%-view' THEN least(first_seen, DATE '2023-12-01') ELSE first_seen END AS first_seen FROM clock", sightings=_SIG, clock=_CLOCK))
def _(v):
    stored = sightings(v.fetch_log()).select("sig", F.when(F.col("sig").endswith("-view"), F.lit("2023-12-01")).otherwise(F.lit("bad date")).alias("seen_date"),
                                             F.lit("2024-01-01").cast("timestamp").alias("seen")).distinct()
    return jobs.first_seen(state_of(v, lambda log: jobs.first_seen_stream(sightings(log), stored, late="60 days"), "t2", "clock"))


@register("t2_first_seen_resumed", V.sql("", "SELECT * FROM clock", sightings=_SIG, clock=_CLOCK))
def _(v):
    """The clock of the first half of the log, and the second half as a stream that goes on from it."""
    early = sightings(v.fetch_log().where(MIDDLE))
    last = early.groupBy("sig").agg(F.max("seen").alias("seen"))
    stored = health.first_seen_clock(early).join(last, "sig").select("sig", F.col("first_seen").cast("string").alias("seen_date"), "seen")
    return jobs.first_seen(state_of(v, lambda log: jobs.first_seen_stream(sightings(log.where(f"not ({MIDDLE})")), stored, late="60 days"), "t2r", "clock"))


@register("w14_evict_oldest", "SELECT sig FROM (SELECT 's' || event_id AS sig, row_number() OVER (ORDER BY CAST(ts AS DATE) DESC, 's' || event_id) AS rn FROM events) WHERE rn <= 5000")
def _(v):
    clock = v.fetch_log().select(F.lit("undated").alias("store"), F.concat(F.lit("s"), F.col("seq").cast("string")).alias("sig"), F.col("ts").cast("date").alias("first_seen"))
    return health.evict_oldest(clock, 5000).select("sig")


@register("t2_retire_old", "SELECT 's' || event_id AS sig FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
def _(v):
    clock = v.fetch_log().select(F.concat(F.lit("s"), F.col("seq").cast("string")).alias("sig"), F.col("ts").cast("date").alias("first_seen"))
    return health.retire_old(clock, F.lit("2024-02-01").cast("timestamp"), days=12).select("sig")


# ---- new matches as a stream --------------------------------------------------------
_T1 = """SELECT DISTINCT user_id % 50 AS search_id, substr(sha256('L|' || event_type || '|' || (event_id % 40) || '|'), 1, 16) AS sig FROM events WHERE event_type <> 'error'"""


def signed(df):
    return df.where("ok").select((F.col("portal") % 50).alias("search_id"), F.lit("L").alias("label"), F.col("event_type").alias("title"),
                                 (F.col("seq") % 40).cast("string").alias("deadline"), F.lit("").alias("url"), F.col("seq").alias("bid_id"), F.col("seq").cast("int").alias("rank"), "ts"
                                 ).withColumn("sig", keys.bid_signature("label", "title", "deadline", "url"))


_T1_RUNS = f"""SELECT s.search_id, substr(sha256(b.town || '|' || b.title || '|' || b.deadline || '|' || b.url), 1, 16) AS sig, count(*) AS n
    FROM bids b JOIN towns t ON t.city = b.town AND t.state = b.town_state JOIN searches s ON {V.sql_distance('s.lat', 's.lon', 't.lat', 't.lon')} <= s.radius GROUP BY ALL"""


@register("t1_stream_new_matches", V.sql("bids towns searches", "SELECT search_id, sig FROM t1", t1=_T1_RUNS))
def _(v):
    """Bids of known towns in shuffled runs, met with all saved searches by radius; a bid comes in one run, so each match is new once."""
    base = root(v, "t1")
    bids = v.bids().select("bid_id", "title", "deadline", "url", "town", "town_state")
    stream = in_batches(bids, f"{base}/in", "bid_id bigint, title string, deadline string, url string, town string, town_state string", "bid_id")
    towns, centres = v.towns(), v.searches().select("search_id", "lat", "lon", "radius")

    def match(batch):
        placed = batch.join(towns.select(F.col("city").alias("town"), F.col("state").alias("town_state"), "lat", "lon"), ["town", "town_state"])
        spots = radius.within_radius(centres, placed.select("town", "town_state", "lat", "lon").distinct())
        return placed.select("town", "town_state", keys.bid_signature("town", "title", "deadline", "url").alias("sig")), spots
    jobs.matches_of_runs(stream, match, "t1-match", f"{base}/matches", base, together=["town", "town_state"]).awaitTermination()
    matches = v.spark.readStream.schema("sig string, before bigint, searches array<bigint>, unnamed boolean, run bigint").parquet(f"{base}/matches")
    jobs.start(jobs.new_matches_stream(matches), "t1-new", base, mode="append", path=f"{base}/new").awaitTermination()
    return v.spark.read.schema("search_id bigint, run bigint, sig string").parquet(f"{base}/new").select("search_id", "sig")


@register("t1_never_again", V.sql("", "SELECT * FROM t1", t1=_T1))
def _(v):
    base = root(v, "t1b")
    matches = jobs.never_again(signed(stream_log(v, base)), late="60 days").select("search_id", "sig")
    (matches.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check")
     .trigger(availableNow=True).start().awaitTermination())
    return v.spark.read.schema("search_id bigint, sig string").parquet(f"{base}/out")


@register("t10_degraded_alerts", V.sql("", "SELECT 'search_blocked' AS fault, portal FROM (SELECT portal, (SELECT count(*) FROM hits g WHERE g.portal = f.portal AND NOT g.ok AND (f.k IS NULL OR g.ts > f.k)) AS n FROM (SELECT portal, max(ts) FILTER (WHERE ok) AS k FROM hits GROUP BY portal) f) WHERE n >= 8", hits=_T4))
def _(v):
    log = v.fetch_log().withColumns({"portal": F.col("portal") % 20, "ok": F.col("seq") % 11 == 0})
    return health.degraded_alerts(health.search_degraded(log, ["portal"])).select("fault", "portal")
