"""Shapes that break at scale: dense places, common heads, keys with most rows, snapshots that grow, state that outlives a run."""

import collections
import glob
import math
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from noticegrid.functions import geo
from noticegrid.functions import text as texts
from noticegrid.operators import common, containment, pages, radius
from noticegrid.plans import alerts, discovery
from noticegrid.sources import sinks
from noticegrid.streaming import jobs


def miles(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1, math.sqrt(h)))


def spread(rnd, lat, lon, within, n):
    """Points evenly over a square around a place."""
    out = []
    for _ in range(n):
        y = lat + rnd.uniform(-within, within) / 69
        x = lon + rnd.uniform(-within, within) / 69 / max(0.01, math.cos(math.radians(min(89.9, abs(y)))))
        out.append((max(-90.0, min(90.0, y)), (x + 180) % 360 - 180))
    return out


@pytest.fixture(scope="module")
def places(spark):
    """A dense town, even country around it, the 180th meridian, and both poles; circles of 3 to 900 miles on them."""
    rnd = random.Random(2)
    points = spread(rnd, 37.2, -93.3, 400, 6000) + spread(rnd, 37.2, -93.3, 3, 1500) + spread(rnd, 52.0, 179.99, 300, 2000)
    points += [(rnd.uniform(86, 90), rnd.uniform(-180, 180)) for _ in range(500)] + [(-90.0, 0.0), (90.0, 77.0), (0.0, 180.0), (0.0, -180.0)]
    centres = [(37.2, -93.3, r) for r in (3, 5, 25, 50, 125, 250)] + [(37.25, -93.35, 5), (52.0, 179.9, 60), (52.1, -179.9, 200), (0.0, 180.0, 5)]
    centres += [(89.5, 10.0, 100), (88.0, -170.0, 250), (-90.0, 0.0, 10), (40.0, -90.0, 900), (37.2, -93.3, 0)]
    points = [(i, *p) for i, p in enumerate(points)]
    centres = [(i, *c) for i, c in enumerate(centres)]
    return (points, centres, spark.createDataFrame(points, "point int, lat double, lon double").cache(),
            spark.createDataFrame(centres, "search_id int, lat double, lon double, radius int").cache())


def test_candidates_of_a_circle_are_near_it(places):
    points, centres, p, s = places
    want = collections.Counter()
    for i, lat, lon, r in centres:
        want[i] = sum(miles(lat, lon, y, x) <= r for _, y, x in points)
    got = radius.within_radius(s, p)
    assert {r["search_id"]: r["count"] for r in got.groupBy("search_id").count().collect()} == {i: n for i, n in want.items() if n}
    celled, placed = radius.by_cell(s, p)
    met = {r["search_id"]: r["count"] for r in placed.join(celled, "_cell").groupBy("search_id").count().collect()}
    assert sum(met.values()) <= 2 * sum(want.values())
    assert all(met[i] <= 3 * n for i, n in want.items() if n > 100)
    assert celled.groupBy("search_id").count().agg(F.max("count")).first()[0] < 160


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_counts_by_cells(places, hot):
    points, centres, p, s = places
    want = {i: n for i, lat, lon, r in centres if (n := sum(miles(lat, lon, y, x) <= r for _, y, x in points))}
    got = radius.counts_within(s, p, ["search_id"], rows_per_task=hot)
    assert {r["search_id"]: r["n"] for r in got.collect()} == want


def test_only_edge_cells_meet_points(places):
    points, centres, p, s = places
    big = s.where("search_id = 5").withColumnsRenamed({"lat": "_clat", "lon": "_clon"}).withColumn("_reach", F.col("radius").cast("double"))
    level = geo.grid_level("_reach") - 2
    cells = geo.with_cells(big, level, inside=True).select("_cell", "_inside")
    at = big.select(level.alias("l")).first()["l"]
    per = p.withColumn("_cell", geo.cell_of("lat", "lon", F.lit(at))).groupBy("_cell").count().join(cells, "_cell")
    n = {r["_inside"]: r["n"] for r in per.groupBy("_inside").agg(F.sum("count").alias("n")).collect()}
    assert n[True] > 4 * n[False]


def test_nearest_first_widens_until_it_has_enough(places):
    points, centres, p, s = places
    first, counts = radius.nearest_first(s, p.withColumns({"city": F.col("point").cast("string"), "state": F.lit("MO")}), 8)
    got = collections.defaultdict(list)
    for r in first.orderBy("search_id", "rank").collect():
        got[r["search_id"]].append(r["point"])
    for i, lat, lon, r in centres:
        near = sorted((round(miles(lat, lon, y, x), 6), str(k), k) for k, y, x in points if miles(lat, lon, y, x) <= r)
        assert got[i] == [k for _, _, k in near[:8]]


def test_containment_by_the_rarest_gram(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9)))
    texts = [f"{word()} {word()} {word()}" for _ in range(400)] + [f"sidewalk replacement {word()} {word()}" for _ in range(200)] + ["", "ab"]
    needles = [t[rnd.randrange(len(t) // 2):][:rnd.randint(1, 20)] for t in rnd.sample(texts[:600], 150)]
    needles += [f"sidewalk replacement {word()}" for _ in range(50)] + ["sidewalk", "a", "zzz", "", "walk replac"]
    t = spark.createDataFrame([(i % 3, i, x) for i, x in enumerate(texts)], "g int, i int, text string")
    n = spark.createDataFrame([(j % 3, x) for j, x in enumerate(dict.fromkeys(needles))], "g int, needle string")
    got = {(r["needle"], r["i"]) for r in containment.containing(n.drop("g").distinct(), t, "needle", "text").collect()}
    assert got == {(x, i) for x in set(needles) if x for i, y in enumerate(texts) if x in y}
    got = sorted((r["g"], r["needle"], r["i"]) for r in containment.containing(n, t, "needle", "text", ["g"]).collect())
    assert got == sorted((j % 3, x, i) for j, x in enumerate(dict.fromkeys(needles)) if x for i, y in enumerate(texts) if i % 3 == j % 3 and x in y)


def test_recall_of_ten_thousand_fragments_with_one_head(spark):
    kept = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("Sidewalk replacement lot "), F.col("id").cast("string")))
                                    .otherwise(F.concat(F.lit("Job "), F.md5(F.col("id").cast("string")))).alias("title"))
    expected = spark.range(10000).select(F.concat(F.lit("SIDEWALK replacement lot "), F.col("id").cast("string")).alias("expected"))
    rows = pages.recall(kept, expected.unionByName(spark.createDataFrame([("",), (None,)], "expected string")))
    got = {r["expected"]: (r["found"], r["recall"]) for r in rows.collect()}
    ids = [str(i) for i in range(0, 9000, 3)]
    begins = {x[:k] for x in ids for k in range(1, 5)}
    want = {i for i in range(10000) if str(i) in begins}
    assert {i for i in range(10000) if got[f"SIDEWALK replacement lot {i}"][0]} == want
    assert got[""][0] and got[None][0] and got[""][1] == pytest.approx((len(want) + 2) / 10002)
    assert not pages.recall(kept.limit(0), spark.createDataFrame([("",)], "expected string")).first()["found"]


def test_ranks_where_one_key_has_most_rows(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 == 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
                                      F.pmod(F.xxhash64("id"), F.lit(1000)).alias("score"), "id").repartition(6).cache()
    order = [F.desc("score"), F.col("id")]
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    sliced = common.ranked_by_slices(rows, ["k"], order, "rank", slices=16)
    assert sliced.exceptAll(plain).isEmpty() and plain.exceptAll(sliced).isEmpty()
    assert common.ranked_rows(rows, ["k"], order, None, "rank", rows_per_sort=1000).exceptAll(plain).isEmpty()
    by = [F.asc_nulls_first("k"), *order, F.xxhash64("k", "score", "id")]
    sizes = [r["count"] for r in rows.repartitionByRange(16, *by).groupBy(F.spark_partition_id(), "k").count().collect()]
    assert max(sizes) <= 2 * rows.count() / 16  # what one task sorts
    assert common.ranked_rows(rows.limit(0), ["k"], order, None, "rank").count() == 0


def files_of(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/part=*/*.parquet")}


def test_a_recheck_rewrites_only_the_parts_it_changes(spark, tmp_path):
    path = f"{tmp_path}/crawl"
    row = lambda i, s: (f"d{i}.gov", s, i)
    shape = "domain string, status string, n int"
    sinks.append_rows(spark.createDataFrame([row(i, "missed") for i in range(200)], shape), path, ["domain"])
    before = files_of(path)
    sinks.append_rows(spark.createDataFrame([row(i, "missed") for i in range(200, 300)], shape), path, ["domain"])
    resumed = files_of(path)
    assert before < resumed
    sinks.rewrite_rows(spark.createDataFrame([row(5, "found"), row(250, "found")], shape), path, ["domain"])
    after = files_of(path)
    changed = {f.split("/")[0] for f in resumed ^ after}
    assert 1 <= len(changed) <= 2
    got = {r["domain"]: (r["status"], r["n"]) for r in sinks.read_snapshot(spark, path).collect()}
    assert got == {f"d{i}.gov": ("found" if i in (5, 250) else "missed", i) for i in range(300)}
    sinks.rewrite_rows(spark.createDataFrame([], shape), path, ["domain"])
    assert files_of(path) == after


def test_the_seen_store_is_not_shuffled(spark, tmp_path):
    seen = spark.range(5000).select((F.col("id") % 7).alias("search_id"), F.col("id").cast("string").alias("sig"))
    alerts.write_seen(seen.unionByName(seen), "seen_scale", f"{tmp_path}/seen", buckets=4)
    spark.sql("DROP TABLE seen_scale")  # as in the session of the next run
    store = alerts.read_seen(spark, "seen_scale", f"{tmp_path}/seen", buckets=4)
    current = spark.range(6000).select((F.col("id") % 7).alias("search_id"), F.col("id").cast("string").alias("sig"), F.lit("x").alias("label"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = alerts.new_for_subscriber(current, store)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert fresh.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the matches of the run


def test_new_matches_keep_the_last_run_of_each_search(spark, tmp_path):
    rnd = random.Random(6)
    runs = [[(s, f"b{b}") for s in range(5) for b in rnd.sample(range(12), rnd.randint(0, 6)) if rnd.random() < 0.8] for _ in range(6)]
    told, store = set(), {}
    for number, rows in enumerate(runs):
        held = collections.defaultdict(set)
        for s, sig in rows:
            held[s].add(sig)
        for s, sigs in held.items():
            told |= {(s, number, x) for x in sigs - store.get(s, set())}
            store[s] = sigs
        spark.createDataFrame([(s, number, x) for s, x in rows * 2], "search_id long, run long, sig string").coalesce(1).write.parquet(f"{tmp_path}/in/run={number}x")
    stream = spark.readStream.schema("search_id long, run long, sig string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    jobs.start(jobs.new_matches_stream(stream), "n", str(tmp_path), mode="append", path=f"{tmp_path}/new").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/new").select("search_id", "run", "sig").collect()} == told
    state = jobs.seen_store(jobs.current(spark, "n", str(tmp_path), "held"), jobs.current(spark, "n", str(tmp_path), "runs"))
    assert {tuple(r) for r in state.collect()} == {(s, x) for s, sigs in store.items() for x in sigs}


def test_benches_are_told_in_order_and_once(spark, tmp_path):
    rnd = random.Random(9)
    log = [(rnd.choice([1, 1, 1, 2]), rnd.randrange(0, 20_000), i, rnd.choice([429, 429, 200, 500])) for i in range(300)]
    want = collections.defaultdict(list)
    for key in (1, 2):
        until = None
        for _, t, _, status in sorted((r for r in log if r[0] == key and r[3] != 500), key=lambda r: (r[1], r[2])):
            if until is not None and until <= t:
                want[key].append((until, False))
                until = None
            if status == 429:
                if until is None:
                    want[key].append((t, True))
                until = t + 300
            elif until is not None:
                want[key].append((t, False))
                until = None
        if until is not None:
            want[key].append((until, False))
    df = spark.createDataFrame([(k, t, s, st, st == 200) for k, t, s, st in [*log, (9, 100_000, 999, 200)]], "portal long, t long, seq long, status int, ok boolean")
    df = df.select("portal", F.timestamp_seconds("t").alias("ts"), "seq", "status", "ok")
    df.where("portal < 9").repartition(5, F.xxhash64("seq")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: jobs.start(jobs.benches_stream(stream, "portal", late="1 day"), "b", str(tmp_path), mode="append", path=f"{tmp_path}/out").awaitTermination()
    run()
    df.where("portal = 9").select("portal", F.timestamp_seconds(F.lit(1_000_000)).alias("ts"), "seq", "status", "ok").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = collections.defaultdict(list)
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("portal", "changed_at", F.col("down")).collect():
        got[r["portal"]].append((int(r["changed_at"].timestamp()), r["down"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_joins_are_not_broadcast_on_an_estimate(spark):
    cells = spark.range(3).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("cell"))  # estimated at 24 bytes
    plan = spark.range(1000).withColumnRenamed("id", "cell").join(cells, "cell")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_tasks_of_a_join_follow_its_pairs(spark):
    left = spark.range(4000).select((F.col("id") % 400).alias("k"), "id")
    right = left.withColumnRenamed("id", "other")
    met = common.split_hot_join(left, right, ["k"], pairs_per_task=2000)
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) > 15 and max(sizes) < 5000


def test_geometry_of_circles_is_worked_out_once(places):
    points, centres, p, s = places
    plan = radius.counts_within(s, p, ["search_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_half" not in plan and "ACOS" not in plan.upper()


# ---- pages of sites, recall, texts of pages -----------------------------------------
def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_guessed_pages_are_sought_among_those_read(spark):
    """The guesses of a site are cut from the pages there are; the answer is that of looking up every guess."""
    base = [f"https://s{i}.gov" for i in range(40)]
    html = "<p>" + "Purchasing office: request for proposal and open bids. " * 8 + "</p>"
    rows = [(u, '<a href="/dept/vendor">Vendor bid list</a>') for u in base] + [(u + "/purchasing", html) for u in base[::3]] + [(u + "/purchasing", html) for u in base[::6]]
    rows += [(base[1] + "/departments/purchasing", html), (base[2] + "/dept/vendor", html), ("https://other.gov/bids", html), (None, html)]
    snap = spark.createDataFrame(rows, "url string, html string")
    sites = spark.createDataFrame([(f" S{i}.gov/ " if i % 2 else f"s{i}.gov",) for i in range(40)] + [("s3.gov",), ("https://S4.gov",), ("",), (None,)], "domain string")
    home = snap.where("url like '%.gov'")
    every, read = pages.site_candidates(sites, home), pages.site_candidates(sites, home, snap)
    known = {r[0] for r in rows}
    key = lambda df: sorted((r["domain"], r["rank"], r["url"]) for r in df.where("guessed").collect())
    assert key(read) == [k for k in key(every) if k[2] in known] and len(key(read)) < 20
    best = lambda c: sorted(map(str, pages.best_bid_page(sites, c, snap, pages.bid_page_platform("html")).collect()))
    assert best(read) == best(every)


def test_titles_are_made_once_for_recall(spark):
    kept = spark.range(40).select(F.concat(F.lit("made from a page "), F.col("id")).alias("title"))
    expected = spark.createDataFrame([("PAGE 7",), ("page 77",), ("",), (None,)], "expected string")
    got = pages.recall(kept, expected)
    assert "made from a page" not in plan_of(got)
    assert {r["expected"]: r["found"] for r in got.collect()} == {"PAGE 7": True, "page 77": False, "": True, None: True}


def test_page_text_is_made_once_and_where_it_is_asked_for(spark):
    listing = '<a href="bids.aspx?bidID=7">Sidewalk</a>'
    html = {1: None, 2: "short", 3: "x" * 300 + "Open <b>bids</b> and RFP", 4: "x" * 200 + listing.upper(), 5: "x" * 400, 6: "x" * 200 + "bids.aspx?bidID=7 rfp open bids" + "y" * 200}
    rows = spark.createDataFrame(list(html.items()), "page_id int, html string")
    read = rows.select("page_id", pages.bid_page_platform("html").alias("v"))
    assert plan_of(read).count("<[^>]+") == 1
    assert {r["page_id"]: r["v"] for r in read.collect()} == {1: None, 2: None, 3: "generic", 4: "civicplus", 5: None, 6: "generic"}
    urls = {1: "https://a.gov/Bids.aspx", 2: "https://a.gov/x", 3: "https://b.gov/Bids.aspx", 4: "https://c.gov/Bids.aspx", 5: "https://d.gov/x"}
    html = {1: listing, 2: "<p>sidewalk repair</p>", 3: "Bid Postings", 4: "nothing", 5: None}
    out = pages.page_outcomes(spark.createDataFrame([(k, urls[k], html[k]) for k in urls], "page_id int, url string, html string"))
    assert "_text" not in plan_of(out)
    assert {r["reason"]: r["n"] for r in out.collect()} == {
        "postings": 1, "for_extraction": 1, "civicplus_no_open_bids": 1, "civicplus_parse_miss": 1, "portal_no_niche_content": 1}


def test_single_blanks_are_left_alone(spark):
    rnd = random.Random(4)
    signs = [" ", " ", "\t", "\n", " ", "　", "\x1c", "\x85", " ", "a", "b", "<", ">", "é", "x<y>z"]
    d = spark.createDataFrame([("".join(rnd.choice(signs) for _ in range(20)),) for _ in range(500)] + [(None,)], "c string")
    plain = lambda c: F.trim(F.regexp_replace(c, texts.WS + "+", " "))
    tags = F.regexp_replace(texts.text("c"), "<[^>]+>", " ")
    assert d.where((texts.collapse("c") != plain(texts.text("c"))) | (texts.clean("c") != plain(tags)) | texts.clean("c").isNull()).isEmpty()
    assert spark.range(1).select(F.regexp_count(F.lit("one two three"), F.lit(texts.RUN))).first()[0] == 0


def test_all_pairs_of_a_search_in_one_task(spark, places):
    """Ranked where they are made: the same ranks as over the shuffled pairs, and no shuffle after the join; ids that come again go the plain way."""
    _, _, p, s = places
    towns = p.select("point", "lat", "lon", F.concat(F.lit("T"), F.col("point") % 900).alias("city"), F.lit("MO").alias("state"))
    near = radius.within_radius(s, towns, whole=True)
    assert set(common.DEAL) <= set(near.columns)
    rows = lambda df: collections.Counter(tuple(r) for r in df.select("search_id", "city", "rank").collect())
    ranked = radius.nearest_k(near)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("SortMergeJoin") and "Exchange" not in plan[plan.index("Window"):plan.index("SortMergeJoin")]
    assert rows(ranked) == rows(radius.nearest_k(radius.within_radius(s, towns)))
    twice = radius.within_radius(s.unionByName(s), towns, whole=True)
    assert not set(common.DEAL) & set(twice.columns)


def test_whole_join_cuts_areas_by_their_pairs(spark):
    rows = spark.range(40).select(F.col("id").alias("row"), (F.col("id") % 2).alias("_area"))
    others = spark.range(60).select(F.col("id").alias("other"), (F.col("id") % 3).alias("_area"))
    met = common.whole_join(rows, others, pairs_per_task=50)
    assert sorted(tuple(r) for r in met.select("row", "other").collect()) == sorted((i, j) for i in range(40) for j in range(60) if i % 2 == j % 3)
    assert met.groupBy("row").agg(F.countDistinct("_area", "_slice").alias("n")).agg(F.max("n")).first()[0] == 1
    assert met.select("_slice").distinct().count() > 1
    assert common.whole_join(rows, others, others_per_row=5) is None


def test_what_a_search_covers_goes_along_with_it(spark, places):
    _, _, p, s = places
    towns = p.select(F.concat(F.lit("T"), "point").alias("city"), F.lit("MO").alias("state"), "lat", "lon")
    portals = towns.select(F.concat(F.lower("city"), F.lit("|MO")).alias("city_key"), F.lit(0).alias("fail_count"))
    all_ = radius.towns_in_reach(s, towns, portals)
    done = all_.where("hash(city_key, search_id) % 3 = 0").select("search_id", "city_key").unionByName(spark.sql("select int(null) search_id, 't1|MO' city_key"))
    key = ["search_id", "city_key"]
    got = radius.towns_in_reach(s, towns, portals, done)
    assert collections.Counter(got.select(*key).collect()) == collections.Counter(all_.select(*key).join(done, key, "left_anti").collect())


def test_pairs_dealt_for_a_further_join_are_as_many_tasks_as_they_need(spark):
    left = spark.range(300).select((F.col("id") % 5).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select((F.col("id") % 5).alias("k"), F.col("id").alias("b"))
    pairs = common.split_hot_join(left, right, ["k"], pairs_per_task=1000, where=F.col("a") > F.col("b"), by=["a"])
    assert pairs.rdd.getNumPartitions() == 18
    assert pairs.count() == sum(i > j for i in range(300) for j in range(300) if i % 5 == j % 5)


def test_leads_are_ranked_where_their_pairs_are_made(spark):
    """Parts of four leads: the ranks go on from part to part, over sources and areas; no pair is shuffled; ids that come again go the plain way."""
    rnd = random.Random(8)
    spots = {"Austin": (30.27, -97.74), "Cambridge": (42.37, -71.11), "Round Rock": (30.51, -97.68)}
    sources = [(i, c, "TX", *at) for i, (c, at) in enumerate(spots.items())] + [(3, "Austin", "TX", 30.4, -97.7)]
    searches = [(i, a + rnd.uniform(-0.7, 0.7), b + rnd.uniform(-0.7, 0.7), rnd.choice([5, 20, 40, 90])) for i, (a, b) in enumerate(list(spots.values()) * 8)] + [(99, None, -97.0, 50)]
    leads = []
    for i in range(160):
        city = rnd.choice([*spots, "Nowhere"])
        a, b = spots.get(city, (30.0, -97.0))
        placed = (a + rnd.uniform(-0.5, 0.5), b + rnd.uniform(-0.5, 0.5)) if i % 3 else (None, None)
        leads.append((f"P{i:03d}", f"P{i:03d}", city, "TX", rnd.choice(["1", "2"]), rnd.choice(["2001-07-01", "2001-07-02", "", None]), *placed, rnd.choice(["open", "builder", "unknown", "taken"])))
    frames = (spark.createDataFrame(searches, "search_id long, lat double, lon double, radius int"),
              spark.createDataFrame(leads, "permit_id string, seq string, city string, state string, zip string, issued_date string, lat double, lon double, lead_type string"),
              spark.createDataFrame(sources, "source_ord int, city string, state string, lat double, lon double"), spark.createDataFrame([("1", 30.3, -97.7)], "zip string, lat double, lon double"))
    want = []
    for i, y, x, r in searches:
        mine = []
        for permit, seq, city, _, code, day, a, b, kind in leads:
            a, b = (a, b) if a is not None else (30.3, -97.7) if code == "1" else (None, None)
            for ord_, town, _, c, d in sources:
                if y is not None and town == city and miles(y, x, c, d) <= r + 25 and (a is None or miles(y, x, a, b) <= r):
                    mine.append((["open", "builder", "unknown", "taken"].index(kind), -int(day[-2:]) if day else -99, seq, ord_, permit))
        want += [(i, permit, ord_, n) for n, (*_, ord_, permit) in enumerate(sorted(mine), 1)]
    key = ["search_id", "permit_id", "source_ord", "rank"]
    got = discovery.residential_leads(*frames, leads_per_part=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("Window"):plan.index("SortMergeJoin")]
    assert want and sorted(tuple(r) for r in got.select(*key).collect()) == sorted(want)
    assert sorted(tuple(r) for r in discovery.residential_leads(*frames).select(*key).collect()) == sorted(want)
    twice = discovery.residential_leads(frames[0].unionByName(frames[0].where("search_id = 3")), *frames[1:]).where("search_id <> 3")
    assert sorted(tuple(r) for r in twice.select(*key).collect()) == sorted(w for w in want if w[0] != 3)


def test_new_matches_by_signature_keep_the_rule_and_a_row_for_each_bid(spark, tmp_path):
    """Bids and who meets their place apart: told as from single matches, also when the stream goes on later, for a search without id and a signature of two places."""
    rnd = random.Random(7)
    meets = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a"), (2, "b"), (3, "b"), (4, "c"), (4, "c")], "search_id long, place string")
    by_place = {"a": {1, 2, None}, "b": {2, 3}, "c": {4}}
    told, store = collections.Counter(), {}
    for number in range(6):
        rows = [(p, f"{rnd.choice([p, 'x'])}{b}") for p in rnd.sample("abc", 2 if number != 3 else 1) for b in rnd.sample(range(8), 4)]
        spark.createDataFrame(rows, "place string, sig string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        bids = spark.readStream.schema("place string, sig string").parquet(f"{tmp_path}/in")
        jobs.matches_of_runs(bids, lambda b: (b, meets), "m", f"{tmp_path}/matches", str(tmp_path), together=["place"]).awaitTermination()
        held = collections.defaultdict(set)
        for place, sig in rows:
            for s in by_place[place]:
                held[s].add(sig)
        for s, sigs in held.items():
            told.update((s, number, x) for x in sigs - store.get(s, set()))
            store[s] = sigs
        if number in (2, 5):
            matches = spark.readStream.schema("sig string, before bigint, searches array<bigint>, unnamed boolean, run bigint").parquet(f"{tmp_path}/matches")
            jobs.start(jobs.new_matches_stream(matches), "n", str(tmp_path), mode="append", path=f"{tmp_path}/new").awaitTermination()
    assert collections.Counter(tuple(r) for r in spark.read.parquet(f"{tmp_path}/new").select("search_id", "run", "sig").collect()) == told
    state = jobs.current(spark, "n", str(tmp_path), "held").collect()
    assert len(state) == len({r["sig"] for r in state}) == len({x for _, _, x in told})
    many = {i * 97: 5 if i % 50 else 4 for i in range(2000)}
    assert jobs.unpacked(jobs.packed(many | {None: 1})) == many | {None: 1} and len(jobs.packed(many)) < 2 * len(many)


def test_signatures_of_a_part_are_read_and_written_at_once():
    class Held:
        rows, calls = [], []

        def get(self):
            self.calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            self.calls.append("put")
            self.rows = rows

        def appendList(self, rows):
            self.calls.append("appendList")
            self.rows = self.rows + rows

    told = jobs.NewForSearches()
    told.held = Held()
    row = lambda sig, run, before, searches: {"sig": sig, "run": run, "before": before, "searches": searches, "unnamed": False}
    tell = lambda *rows: {(r["sig"], r["run"]): r["searches"] for r in told.handleInputRows((0,), iter(rows), None)}
    assert len(tell(*[row(f"s{i}", 0, None, [1, 2]) for i in range(300)])) == 300 and told.held.calls == ["get", "appendList"]
    assert tell(row("n", 1, 0, [1])) == {("n", 1): [1]} and told.held.calls[2:] == ["get", "appendList"]
    assert tell(row("s1", 1, 0, [2, 3]), row("s2", 2, 1, [1]), row("s2", 1, 0, [1])) == {("s1", 1): [3]} and told.held.calls[4:] == ["get", "put"]
    assert len(told.held.rows) == 301 and jobs.unpacked(dict(told.held.rows)["s1"]) == {1: 0, 2: 1, 3: 1}
