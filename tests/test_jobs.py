"""Operators and jobs on small inputs: brute-force comparisons, invariants, golden rows."""

import collections
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from noticegrid import session
from noticegrid.functions import keys
from noticegrid.functions import text as T
from noticegrid.operators import common, health, ledger, pages, placing, radius
from noticegrid.operators import bids as bid_ops
from noticegrid.plans import alerts, scan
from noticegrid.streaming import jobs

NOW = lambda: F.lit("2026-08-01 12:00:00").cast("timestamp")


def miles(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_grid_join_equals_brute_force_everywhere(spark, hot):
    rnd = random.Random(5)
    spots = [(i, rnd.uniform(-89.9, 89.9), rnd.uniform(-180, 180)) for i in range(250)]
    spots += [(1000 + i, 52 + rnd.random(), rnd.choice([179.9, -179.9, 179.5])) for i in range(20)]
    centres = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180), rnd.choice([25, 125, 900])) for i in range(40)]
    centres += [(100, 52.5, 179.95, 60), (101, 52.5, -179.95, 60), (102, 89.5, 0.0, 300)]
    s = spark.createDataFrame(centres, "search_id int, lat double, lon double, radius int")
    p = spark.createDataFrame(spots, "point int, lat double, lon double")
    got = radius.within_radius(s, p, rows_per_task=hot).select("search_id", "point").collect()
    want = {(c[0], q[0]) for c in centres for q in spots if miles(c[1], c[2], q[1], q[2]) <= c[3]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hot_key_join_and_rank_and_top_k(spark):
    left = spark.range(3000).select((F.col("id") % 10 == 0).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k int, v string")
    got = common.split_hot_join(left, right, ["k"], rows_per_task=100)
    assert got.exceptAll(left.join(right, "k").select(got.columns)).count() == 0 and got.count() == 2700 * 2 + 300
    score = F.col("id") % 7
    rows = left.withColumn("s", score)
    ranked = common.rank_all(rows, ["k"], [-F.col("s"), F.floor(F.col("id") / 64)], [-F.col("s"), F.col("id")])
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(-F.col("s"), "id")))
    assert ranked.select("k", "id", "rank").exceptAll(plain.select("k", "id", "rank")).count() == 0
    top = common.top_k(left, ["k"], [F.desc("id")], 1500)
    assert top.where("k = 0").agg(F.count("*"), F.min("id")).first()[0] == 1500


GOLDEN = """<table><tr><td><a href="bids.aspx?bidID=31">Uniform laundry service</a></td><td>Quote only ... <a href="bids.aspx?bidID=31">Read on</a></td>
<td>Status:</td><td>Closes:</td></tr><tr><td>Open</td><td>6/2/2027 1:00 PM</td></tr>
<tr><td><a href="bids.aspx?bidID=44">Harbor Walk ADA ramp work &amp; curb repair</a> long text (<a href="bids.aspx?bidID=44"><i>&nbsp;Read</i> on</a>)
<b>Status:</b><b>Closes:</b> <i>Open</i> 7/19/2027 2:00 PM</td></tr>
<tr><td><a class="job" href="bids.aspx?bidID=45">Elm &amp; Third sidewalk panels</a> y <b>Status:</b> Closes: Closed 2/1/2024</td></tr>
<tr><td><a href="bids.aspx?bidID=45">Elm and Third, listed twice</a></td></tr><a href="bids.aspx?bidID=7">Xy</a> Status: Open
<tr><td><a href="bids.aspx?bidID=29">Cafe lease at the marina</a> Due date to come</td></tr></table>"""


def test_listing_page(spark):
    df = spark.createDataFrame([(1, "https://www.x.gov/Bids.aspx", GOLDEN)], "page_id int, url string, html string")
    rows = {r.url[-2:]: r for r in pages.posting_rows(df).collect()}
    assert set(rows) == {"31", "44", "45", "29"}
    assert rows["44"].title == "Harbor Walk ADA ramp work & curb repair" and rows["44"].deadline == "7/19/2027"
    assert rows["45"].status == "Closed" and rows["45"].title.startswith("Elm & Third")
    assert rows["31"].status == "Open" and rows["31"].url == "https://www.x.gov/bids.aspx?bidID=31"
    assert rows["29"].status == "" and rows["29"].deadline == ""
    assert {r.url[-2:] for r in pages.postings_from_pages(df).collect()} == {"44", "45"}
    got = {r.expected: r for r in pages.recall(pages.postings_from_pages(df), spark.createDataFrame([("harbor walk ada",), ("elm & third",), ("laundry",)], "expected string")).collect()}
    assert got["harbor walk ada"].found and got["elm & third"].found and not got["laundry"].found
    assert abs(got["laundry"].recall - 2 / 3) < 1e-9


@pytest.mark.parametrize("middle", [" " * 1_000_000, "<b>" * 300_000, "&nbsp;" * 200_000, "a longer summary of it. " * 40_000])
def test_a_posting_outlives_any_page(spark, middle):
    link = '<a href="bids.aspx?bidID=%d">'
    page = f"{link % 1}{middle[:600_000] if middle[0] != 'a' else ''}Curb job one</a>{middle}{link % 1}{middle[:600_000] if middle[0] != 'a' else ''}Read on</a> Status: Open Closes: 8/19/2026 {link % 2}never closed {middle}"
    df = spark.createDataFrame([(1, "https://x.gov/Bids.aspx", page)], "page_id int, url string, html string")
    rows = pages.posting_rows(df).collect()
    assert [(r.title, r.deadline, r.url[-1]) for r in rows] == [("Curb job one", "8/19/2026", "1")]


def test_feed_items_at_any_depth(spark):
    item = "<item><title>Curb &amp; gutter</title><link> https://f.gov/1\n</link><description><![CDATA[Status: Open <b>Closes:</b> 8/1/2027]]></description></item>"
    feeds = [(1, f"<rss><channel>{item}</channel></rss>"), (2, f'<rdf:RDF xmlns:rdf="u"><channel/>{item}{item}</rdf:RDF>'), (3, f"<rss><channel>{item}"), (4, None), (5, "")]
    got = pages.feed_items(spark.createDataFrame(feeds, "feed_id int, xml string")).collect()
    assert sorted((r.feed_id, r.pos) for r in got) == [(1, 0), (2, 0), (2, 1)]
    assert {(r.title, r.url, r.status) for r in got} == {("Curb & gutter", "https://f.gov/1", "Open")}


def test_an_end_revokes_the_key_its_email_holds(spark):
    events = [(1, "checkout.session.completed", "A", "me@x.y"), (2, "checkout.session.completed", "B", "Me@x.y"), (3, "customer.subscription.deleted", "A", ""),
              (4, "checkout.session.completed", "C", "other@x.y")]
    df = spark.createDataFrame([(i, i, t, c, e, "d", 100) for i, t, c, e in events], "s long, seq long, type string, customer string, email string, device string, amount_total long")
    got = {r.customer: r.revoked for r in ledger.entitlements(df.withColumn("ts", F.timestamp_seconds("s"))).collect()}
    assert got == {"A": False, "B": True, "C": False}


def test_all_entities_and_every_blank(spark):
    df = spark.createDataFrame([("a &ndash; b &#233; &#x4e2d; &nope; &amp;lt; x&nbsp;y",)], "t string")
    assert df.select(T.unescape_all("t")).first()[0] == "a – b é 中 &nope; &lt; x\u00a0y"
    rows = spark.createDataFrame([("Main\u00a0 St",), ("Main  St",)], "t string")
    assert rows.select(keys.title_key("t")).distinct().count() == 1


def test_a_checkpoint_folder_has_to_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        def getConf(self):
            return {}
    class Session:
        conf, sparkContext = {}, Context()
    with pytest.raises(ValueError):
        session.checkpoint_root(Session())


TOWNS = [("Ashland", "MO", 38.77, -92.26), ("Olathe", "KS", 38.88, -94.82), ("Olathr", "KS", 38.0, -94.0),
         ("Aurora", "MO", 36.97, -93.72), ("Springfield", "MO", 37.21, -93.29), ("Bentonville", "AR", 36.37, -94.21)]
REGISTRY = [("dupage.gov", "County", "DuPage County", "Wheaton", "IL"), ("greene.gov", "County", "Greene County", "Springfield", "MO"),
            ("greeneil.gov", "County", "Greene County", "Carrollton", "IL")]


def bid(i, city, default_city="Springfield", default_state="MO", centre="MO", **kw):
    row = {"bid_id": i, "seq": i, "title": f"Curb job {i}", "scope": "", "status": "Open", "deadline": "2026-09-01", "contact": "",
           "email": "", "phone": "", "value": "", "url": f"https://x.gov/{i}", "city": city, "published": "", "default_city": default_city,
           "default_state": default_state, "center_state": centre, "fallback_lat": 37.2, "fallback_lon": -93.3}
    return {**row, **kw}


SCHEMA = ("bid_id long, seq long, title string, scope string, status string, deadline string, contact string, email string, phone string, "
          "value string, url string, city string, published string, default_city string, default_state string, center_state string, "
          "fallback_lat double, fallback_lon double")


def frames(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return (spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA),
            spark.createDataFrame(TOWNS, "city string, state string, lat double, lon double"),
            spark.createDataFrame(REGISTRY, "domain string, type string, org string, city string, state string"))


def test_placing(spark):
    rows = [bid(1, "Ashlan"), bid(2, "Olathi", default_state="KS"), bid(3, "Aurora"), bid(4, "Bentonville, AR"), bid(5, "Bentonville"),
            bid(6, "Bentonville", default_state="AR"), bid(7, "DuPage County"), bid(8, "Greene County"), bid(9, "Binghamton"),
            bid(10, "", default_city=""), bid(11, ""), bid(12, "Springfield, IL"), bid(13, "Smallville", default_city="Smallville"),
            bid(14, "City of Aurora"), bid(15, "Ashlan", default_state="KS"), bid(16, "Polk County", fallback_lat=None)]
    placed = {r.bid_id: r for r in placing.place_bids(*frames(spark, rows)).collect()}
    assert (placed[1].place_city, placed[1].place_state, placed[1].city_name_corrected) == ("Ashland", "MO", True)
    assert placed[2].drop_reason == "unresolvable_place" and not placed[2].city_name_corrected
    assert placed[3].place_state == "MO" and placed[4].place_state == "AR" and placed[5].drop_reason == "unresolvable_place"
    assert placed[6].place_state == "AR" and placed[7].drop_reason == "authority_in_another_state"
    assert placed[8].placed_by_search_town and placed[8].lat == 37.2 and placed[9].drop_reason == "unresolvable_place"
    assert placed[10].drop_reason == "no_location" and placed[11].place_city == "Springfield" and placed[12].drop_reason == "unresolvable_place"
    assert placed[13].placed_by_search_town and placed[14].lat == 36.97 and placed[16].drop_reason == "unresolvable_place"
    assert (placed[15].place_city, placed[15].place_state) == ("Ashland", "MO")  # the centre's state is tried second


def test_scan_funnel_adds_up_and_alerts(spark):
    rows = [bid(i, "Springfield", title=f"Curb {i % 6}", deadline="" if i % 5 == 0 else "2026-09-01", status="Open" if i % 4 else "Closed") for i in range(40)]
    rows += [bid(100, "Bentonville, AR"), bid(101, "Aurora"), bid(102, "Greene County"),
             bid(103, "Greene County", title="Curb job 102", fallback_lat=37.3), bid(104, "Nowhere")]
    bids, gaz, reg = frames(spark, rows)
    searches = spark.createDataFrame([(1, 37.2, -93.3, "MO", 60), (2, 36.4, -94.2, "AR", 10), (3, 10.0, 10.0, "TX", 50)],
                                     "search_id int, lat double, lon double, state string, radius int")
    prepared = scan.prepare(bids, gaz, reg, NOW())
    n = prepared.agg(F.sum("copies").alias("n_placed"))
    assert n.first()[0] == 44
    rows_out = scan.scan(searches, prepared)
    funnel = {(r.search_id, r.reason): r.n for r in scan.scan_funnel(searches, rows_out, n).collect()}
    for s in (1, 2, 3):
        assert sum(funnel.get((s, k), 0) for k in ("out_of_radius", "duplicate", "kept")) == 44
    assert funnel[(2, "kept")] == 1 and funnel[(1, "kept")] + funnel[(1, "duplicate")] == 43 and funnel[(3, "out_of_radius")] == 44
    out = {r.bid_id: r for r in rows_out.collect() if r.search_id == 1}
    assert 102 in out and 103 not in out and out[101].label == "Aurora" and out[101].rank == 1
    wide = scan.attach(rows_out, prepared, ["title", "deadline", "url"])
    first = alerts.alerts(rows_out, prepared, spark.createDataFrame([], "search_id int, sig string"))
    opened = wide.where("is_open").count()
    assert first["new"].count() == opened == first["seen"].count()
    assert alerts.alerts(rows_out, prepared, first["seen"])["new"].count() == 0
    text = {r.search_id: r for r in first["digest"].collect()}[2]
    assert text.n_new == 1 and text.body == "- Curb job 100 — Bentonville (due 2026-09-01)\n  https://x.gov/100"


def test_one_place_with_most_bids_and_searches(spark, monkeypatch):
    rows = [bid(i, "Springfield" if i % 10 else "Aurora", title=f"Curb {i}") for i in range(200)]
    bids, gaz, reg = frames(spark, rows)
    centres = [(i, 37.2, -93.3, "MO", 20 if i % 10 else 60) for i in range(60)]
    searches = spark.createDataFrame(centres, "search_id int, lat double, lon double, state string, radius int")
    cut = common.split_hot_join
    monkeypatch.setattr(scan, "split_hot_join", lambda left, right, on: cut(left, right, on, rows_per_task=7))
    prepared = scan.prepare(bids, gaz, reg, NOW())
    got = scan.scan(searches, prepared).groupBy("search_id").count().collect()
    assert {r["search_id"]: r["count"] for r in got} == {i: 180 if i % 10 else 200 for i in range(60)}
    plan = prepared._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan


def test_enrichment_fills_only_blanks_and_keeps_the_budget(spark):
    rows = [bid(i, "Springfield", deadline="") for i in range(20)] + [bid(50, "Springfield", email="a@b.c")]
    bids, gaz, reg = frames(spark, rows)
    details = bids.select("url", F.lit("Ann Poe").alias("contact"), F.lit("x@y.gov").alias("email"), F.lit("").alias("phone"),
                          F.lit("7/1/2026").alias("deadline"), F.lit("").alias("scope"), F.lit("$9,000").alias("value"), F.lit("").alias("published"),
                          F.lit("").alias("bid_number"), F.lit("").alias("prebid"), F.lit(True).alias("addenda"), F.array(F.lit("d")).alias("documents"))
    searches = spark.createDataFrame([(1, 37.2, -93.3, "MO", 60)], "search_id int, lat double, lon double, state string, radius int")
    prepared = scan.prepare(bids, gaz, reg, NOW(), details=details)
    out = {r.bid_id: r for r in scan.attach(scan.scan(searches, prepared, enrich_limit=14), prepared, ["email", "deadline", "value"]).collect()}
    read = [i for i, r in out.items() if r.enriched]
    assert sorted(read) == list(range(14)) and all(out[i].status == "Closed" and out[i].email == "x@y.gov" for i in read)
    assert out[15].status == "Open" and out[15].email == "" and out[50].email == "a@b.c" and not out[50].enriched
    everything = scan.scan(searches, prepared)
    assert everything.where("enriched").count() == 20
    rich = {r.bid_id: r for r in bid_ops.enrich_from_details(bids, details).collect()}
    assert rich[50].email == "a@b.c" and rich[50].deadline == "2026-09-01" and rich[3].deadline == "7/1/2026" and rich[3].addenda


def test_streak_stream_over_shuffled_batches_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), f"2026-01-{1 + i // 60:02d} 00:{i % 60:02d}:00", i, rnd.random() < 0.2) for i in range(300)]
    df = spark.createDataFrame(rows, "portal long, t string, seq long, ok boolean").select("portal", F.to_timestamp("t").alias("ts"), "seq", "ok")
    df.repartition(6, F.xxhash64("seq")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.start(jobs.streaks_stream(stream, "portal"), "h", str(tmp_path)).awaitTermination()
    got = {r.portal: (r.fail_count, r.last_ok) for r in jobs.streaks(jobs.current(spark, "h", str(tmp_path), "streak"), "portal").collect()}
    assert got == {r.portal: (r.fail_count, r.last_ok) for r in health.portal_health(df).collect()}


def test_late_results_do_not_turn_a_streak_back():
    held = jobs.streaks_after(None, [(100, 1, True)], 0)
    held = jobs.streaks_after(held, [(10, 2, True), (20, 3, False)], 0)
    assert held[0] == 100 and held[3] + len(held[4]) == 0
    held = jobs.streaks_after(held, [(110, 4, False), (130, 5, False)], 0)
    held = jobs.streaks_after(held, [(120, 6, True)], 0)  # a success between two failures comes last
    assert held[0] == 120 and held[4] == [130]
    held = jobs.streaks_after(held, [(140, 7, False)], 135)
    assert held[3] == 1 and held[4] == [140]  # 130 is settled: no success before it can come any more


def test_first_seen_clock_restarts_bad_dates_and_forgets(spark, tmp_path):
    store = spark.createDataFrame([("a", "2025-12-01"), ("b", "soon")], "sig string, seen_date string").withColumn("seen", F.lit("2026-01-01").cast("timestamp"))
    days = [("a", "2026-01-02"), ("b", "2026-01-03"), ("old", "2026-01-01")]
    later = [("b", "2026-05-01"), ("c", "2026-05-02")]
    for part in (days, later, [("c", "2026-05-03")]):
        seen = spark.createDataFrame(part, "sig string, t string").select("sig", F.col("t").cast("timestamp").alias("seen"))
        seen.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        clock = jobs.first_seen_stream(spark.readStream.schema("sig string, seen timestamp").parquet(f"{tmp_path}/in"),
                                       store, late="1 day")
        jobs.start(clock, "c", str(tmp_path)).awaitTermination()
        if part is days:
            got = {r.sig: str(r.first_seen) for r in jobs.first_seen(jobs.current(spark, "c", str(tmp_path), "clock")).collect()}
            assert got == {"a": "2025-12-01", "b": "2026-01-03", "old": "2026-01-01"}


def test_seen_store_is_replaced_so_a_returning_bid_alerts_again(spark, tmp_path):
    counts = []
    for i, sigs in enumerate((["a", "b"], ["b"], ["a", "b"])):
        rows = [(1, s) for s in sigs] + ([(2, "z")] if i != 1 else [])
        spark.createDataFrame(rows, "search_id long, sig string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        bids = spark.readStream.schema("search_id long, sig string").parquet(f"{tmp_path}/in")
        jobs.matches_of_runs(bids, lambda b: b, "m", f"{tmp_path}/matches", str(tmp_path)).awaitTermination()
        matches = spark.readStream.schema("search_id long, sig string, run long").parquet(f"{tmp_path}/matches")
        jobs.start(jobs.new_matches_stream(matches), "n", str(tmp_path), mode="append", path=f"{tmp_path}/new").awaitTermination()
        counts.append(spark.read.parquet(f"{tmp_path}/new").where("search_id = 1").count())
    assert counts == [2, 2, 3]  # 'a' vanished in the second run and is new again in the third
    assert spark.read.parquet(f"{tmp_path}/new").where("search_id = 2").count() == 1  # its store outlived a run without matches


def test_top_k_prunes_before_the_shuffle_and_lookups_do_not_cross_join(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = common.top_k(rows, ["k"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    bids, gaz, reg = frames(spark, [bid(1, "Ashlan")])
    searches = spark.createDataFrame([(1, 37.2, -93.3, "MO", 60)], "search_id int, lat double, lon double, state string, radius int")
    plan = radius.within_radius(searches, gaz)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    placed = placing.place_bids(bids, gaz, reg)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in placed and "BroadcastNestedLoopJoin" not in placed


def test_matches_are_not_written_and_ranks_hold_for_labels_that_are_alike(spark):
    rows = [bid(i, "Springfield", title=f"Curb {i}", value="$5" if i % 3 else "") for i in range(30)]
    rows += [bid(100 + i, "Greene County", title=f"Ramp {i}", fallback_lat=37.2 + (i % 2) / 10) for i in range(6)]
    bids, gaz, reg = frames(spark, rows)
    twice = [(1, 37.2, -93.3, "MO", 60), (2, 37.2, -93.3, "MO", 60), (2, 37.25, -93.3, "MO", 60)]
    searches = spark.createDataFrame(twice, "search_id int, lat double, lon double, state string, radius int")
    prepared = scan.prepare(bids, gaz, reg, NOW())
    got = scan.scan(searches, prepared).collect()
    for s, n in ((1, 1), (2, 2)):
        for label in {r.label for r in got}:
            mine = sorted((r for r in got if r.search_id == s and r.label == label), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == n * len({r.bid_id for r in mine})
            assert [(-r.score, r.seq) for r in mine] == sorted((-r.score, r.seq) for r in mine)
    assert len([r for r in got if r.search_id == 1]) == 36
    one = scan.scan(searches.where("search_id = 1"), scan.prepare(bids.where("bid_id < 100"), gaz, reg, NOW()))
    assert "pairs-" not in " ".join(one.inputFiles()) and one.count() == 30


def test_matches_apart_tell_what_single_matches_tell(spark):
    """Also for places of several points, searches without an id or with one that comes again, and a bid that is there twice; nothing is kept by (search, place)."""
    rows = [bid(i, "Springfield" if i % 3 else "Aurora", title=f"Curb {i % 50}" if i % 7 else "", url="u" if i % 14 == 0 else f"https://x.gov/{i}") for i in range(90)]
    rows += [bid(200 + i, "Greene County", title=f"Ramp {i}", fallback_lat=37.2 + (i % 2) / 10) for i in range(6)] + [bid(5, "Springfield", title="Curb 5")]
    bids, gaz, reg = frames(spark, rows)
    centres = [(i, 37.2, -93.3, "MO" if i % 2 else "AR", 60 if i % 3 else 5) for i in range(12)] + [(None, 37.2, -93.3, "MO", 60), (3, 37.0, -93.7, "MO", 60)]
    searches = spark.createDataFrame(centres, "search_id int, lat double, lon double, state string, radius int")
    prepared = scan.prepare(bids, gaz, reg, NOW())
    single, apart = scan.scan(searches, prepared), scan.scan(searches, prepared, apart=True)
    seen = alerts.current_signatures(single).where("bid_id % 4 = 0").select("search_id", "sig")
    assert same_rows(alerts.current_signatures(apart).where("bid_id % 4 = 0").pairs("sig"), seen)
    want, got = alerts.alerts(single, prepared, seen), alerts.alerts(apart, prepared, seen)
    assert want["new"].where("search_id is null").count() and want["new"].count() < want["current"].count()
    for part in ("new", "digest", "seen"):
        assert same_rows(got[part], want[part]), part
    assert same_rows(got["current"].pairs("label", "bid_id", "sig"), want["current"])
    own = single.where("search_id = 1")
    assert sorted(alerts.seen_after(got["current"], 9).where("search_id = 1").collect()) == sorted(alerts.seen_after(alerts.current_signatures(own), 9).collect())
    few = scan.scan(searches.where("search_id = 1"), scan.prepare(bids.where("bid_id < 100"), gaz, reg, NOW()))
    assert few.count() and not [f for f in few.inputFiles() if "/near-" in f or "/pairs-" in f]


def same_rows(left, right):
    columns = sorted(set(left.columns) & set(right.columns))
    rows = lambda df: collections.Counter(tuple(r) for r in df.select(*columns).collect())
    return len(columns) > 1 and rows(left) == rows(right)


def test_columns_that_matches_carry_are_not_joined_again(spark):
    bids, gaz, reg = frames(spark, [bid(i, "Springfield", title=f"Curb {i}", phone="555" if i % 2 else "") for i in range(20)])
    details = bids.select("url", *[F.lit("417" if c == "phone" else "").alias(c) for c in bid_ops.DETAIL_FIELDS], F.lit(False).alias("addenda"), F.array(F.lit("d")).alias("documents"))
    searches = spark.createDataFrame([(1, 37.2, -93.3, "MO", 60)], "search_id int, lat double, lon double, state string, radius int")
    prepared = scan.prepare(bids, gaz, reg, NOW(), details=details)
    carried = scan.attach(scan.scan(searches, prepared, columns=["phone"]), prepared, ["phone"])
    assert same_rows(carried, scan.attach(scan.scan(searches, prepared), prepared, ["phone"])) and not [f for f in carried.inputFiles() if "/prepared-" in f]
    twice = scan.prepare(bids.unionByName(bids.where("bid_id = 3").withColumns({"title": F.lit("Other"), "phone": F.lit("777")})), gaz, reg, NOW(), details=details)
    matches = scan.scan(searches, twice, columns=["phone"])
    assert same_rows(scan.attach(matches, twice, ["phone"]), scan.attach(scan.scan(searches, twice), twice, ["phone"]))
