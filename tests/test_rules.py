"""Golden rows of the Column rules."""

import datetime as dt

from pyspark.sql import functions as F

from noticegrid.functions import dates, geo, keys, leads, money, places, posting, relevance, text, urls


def run(spark, values, fn, *extra):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select(fn(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_parse_deadline(spark):
    cases = {
        "2026-12-01": dt.date(2026, 12, 1), "12/01/2026": dt.date(2026, 12, 1),
        "12-01-2026": dt.date(2026, 12, 1), "December 1, 2026": dt.date(2026, 12, 1),
        "Due by 12/01/2026 at 2:00 PM": dt.date(2026, 12, 1),
        "Thursday, December 1, 2026": dt.date(2026, 12, 1), "Sept. 1, 2026": dt.date(2026, 9, 1),
        "Dec 1 2026": dt.date(2026, 12, 1), "may 5, 2026": dt.date(2026, 5, 5),
        "12/1/26": dt.date(2026, 12, 1), "1/2/75": dt.date(1975, 1, 2),
        "2026-1-5": dt.date(2026, 1, 5), "2026-13-45 or 12/02/2026": dt.date(2026, 12, 2),
        "December 1, 2026": dt.date(2026, 12, 1),
        "Posted 3/4/2026, closes 2026-05-06": dt.date(2026, 5, 6),
        "FY2024": None, "Due 2025": None, "2025 cycle": None, "": None, "02/30/2026": None, "February 30, 2026": None,
    }
    assert run(spark, list(cases), dates.parse_deadline) == list(cases.values())


def test_deadline_moment(spark):
    cases = {
        "08/19/2026 01:00 AM EDT": "2026-08-19 05:00", "Bids due December 1, 2026 at 2:00 PM CST": "2026-12-01 20:00",
        "12/01/2026 2:00 PM": "2026-12-02 00:00", "12/01/2026 12:00 AM UTC": "2026-12-01 00:00",
        "12/01/2026 12.30 p.m. GMT": "2026-12-01 12:30", "12/01/2026 25:00 PM": None, "December 1, 2026": None,
    }
    got = run(spark, list(cases), lambda c: F.date_format(dates.deadline_moment(c), "yyyy-MM-dd HH:mm"))
    assert got == list(cases.values())


def test_deadline_status_and_stale_years(spark):
    now = F.lit("2026-08-19 06:00:00").cast("timestamp")
    got = run(spark, ["2024-05-01", "FY2024", "", "FY2026", "08/19/2026 01:00 AM EDT", "2026-08-19"],
              lambda c: dates.deadline_status(F.lit("Open"), c, now))
    assert got == ["Closed", "Closed", "Open", "Open", "Closed", "Open"]
    got = run(spark, ["2025 Sidewalk Program", "2025-2026 Programme", "Curbs"],
              lambda c: dates.stale_year_status(F.lit("Open"), F.lit(""), c, F.lit(""), now))
    assert got == ["Closed", "Open", "Open"]


def test_clean_deadline(spark):
    got = run(spark, ["In 8 days", "TBD", "n/a", "FY2027", "December 1, 2026", " 3  days left "], dates.clean_deadline)
    assert got == ["", "", "", "FY2027", "December 1, 2026", ""]


def test_age_out(spark):
    now = F.lit("2026-08-19").cast("timestamp")
    f = lambda pub, seen: lambda c: dates.age_out_status(F.lit("Open"), c, F.lit(pub), F.lit(seen).cast("date"), now)
    assert run(spark, [""], f("", None)) == ["Open"]
    assert run(spark, [""], f("", "2026-06-20")) == ["Closed"]
    assert run(spark, [""], f("", "2026-06-21")) == ["Open"]
    assert run(spark, [""], f("January 5, 2026", "2026-08-18")) == ["Closed"]
    assert run(spark, [""], f("August 5, 2026", "2025-01-01")) == ["Open"]
    assert run(spark, ["2026-12-01"], f("", "2020-01-01")) == ["Open"]


def test_close_date_and_status(spark):
    rows = {
        "Bid Title Closing Date/Time: 12/1/2026 2:00 PM": "12/1/2026",
        "Bid Opening Date/Time: March 3, 2026": "March 3, 2026",
        "Due Date and Time 2026-11-20": "2026-11-20",
        "Status: Closes: Open 8/19/2026 3:00 PM": "", "no date here": "",
    }
    assert run(spark, list(rows), dates.close_date)[:3] == list(rows.values())[:3]
    got = run(spark, ["Status: Closes: Closed 3/11/2025", "status open", "Status: cancelled", "x"], dates.status_near)
    assert got == ["Closed", "Open", "Cancelled", ""]


def test_relevance(spark):
    keep = ["Sidewalk replacement", "ADA ramps", "Curb & gutter", "Concrete flatwork", "Street improvement 2026",
            "Sidewalk replacement and landscaping", "Parking lot resurfacing"]
    drop = ["Janitorial services", "Nevada office lease", "Legal Services for Digital Infrastructure", "", "Copier"]
    assert all(run(spark, keep, relevance.looks_relevant))
    assert not any(run(spark, drop, relevance.looks_relevant))
    assert run(spark, ["Janitorial audit", "Ice machines"], relevance.rejection_reason) == [
        "unrelated:janitorial", "no_niche_keyword"]


def test_open_words(spark):
    opened = ["Accepting Bids", "Active", "Open - Bids Due 12/1/2026", "", "Award"]
    closed = ["Bid Closed", "Award to Acme Concrete", "Cancelled", "No Longer Accepting", "Complete", "incomplete"]
    assert all(run(spark, opened, relevance.is_open))
    assert not any(run(spark, closed, relevance.is_open))


def test_awarded(spark):
    got = run(spark, ["Council awarded the contract to Acme", "Sealed bids will be received; bid was accepted",
                      "Notice of award. Bids due Friday", "plain"], relevance.looks_awarded)
    assert got == [True, False, False, False]


def test_declares_closed(spark):
    got = run(spark, ["Status: Closed"], lambda c: F.struct(
        relevance.declares_closed(c, F.lit(1)), relevance.declares_closed(c, F.lit(2))))
    assert tuple(got[0]) == (True, False)


def test_contact(spark):
    page = ("<p>Contact: Marla Whitfield Email: mwhitfield@example-city.gov</p>webmaster@x.gov "
            "Phone (417) 864-1976 fax")
    f = lambda fn: run(spark, [page], lambda c: fn(text.visible(c)))[0]
    assert f(posting.contact_email) == "mwhitfield@example-city.gov"
    assert f(posting.contact_phone) == "(417) 864-1976"
    assert f(posting.contact_name) == "Marla Whitfield"
    got = run(spark, ["contact us for details", "Contact The City Of Aurora", "417-864-19", "webmaster@a.gov"],
              lambda c: F.concat(posting.contact_name(c), posting.contact_phone(c), posting.contact_email(c)))
    assert got == ["", "", "", ""]


def test_details(spark):
    vals = ["Engineer's estimate: $220,000", "Estimated cost $5,000 bid bond. Project estimate is $310,500.00",
            "Plan deposit $1,000", "Estimated value: $99"]
    assert run(spark, vals, posting.detail_value) == ["$220,000", "", "", ""]
    far = "Estimated cost bid bond $5,000." + " " * 0 + "x" * 80 + " Project estimate is $310,500.00"
    assert run(spark, [far], posting.detail_value) == ["$310,500.00"]
    assert run(spark, ["Publication Date/Time: 3/4/2026 8:00"], posting.detail_published) == ["3/4/2026"]
    assert run(spark, ["Bid No. 015-2027IFB", "Bid Number: Bid", "Bid # A-1/"], posting.detail_bid_number) == [
        "015-2027IFB", "", "A-1"]
    assert run(spark, ["A mandatory pre-bid meeting", "Pre-bid conference May 1", "none"], posting.detail_prebid) == [
        "mandatory", "yes", ""]
    docs = ('<a href="/DocumentCenter/View/12">a</a><a href="x.pdf">b</a><a href="x.pdf">b</a>'
            '<a href="/DocumentCenter">i</a>')
    got = run(spark, [docs], lambda c: posting.detail_documents(c, F.lit("https://a.gov/b/c.aspx")))
    assert got == [["https://a.gov/DocumentCenter/View/12", "https://a.gov/b/x.pdf"]]
    body = "Scope of work: " + "Replace the sidewalk along Main Street, both sides. " + "Contact: Jane"
    assert run(spark, [body], posting.detail_scope) == ["Replace the sidewalk along Main Street, both sides."]


def test_urls(spark):
    base = "https://x.gov/a/Bids.aspx?q=1"
    cases = {"bids.aspx?bidID=4": "https://x.gov/a/bids.aspx?bidID=4", "/r?x": "https://x.gov/r?x",
             "../b/./c": "https://x.gov/b/c", "//y.gov/z": "https://y.gov/z", "http://q.com/1": "http://q.com/1",
             "mailto:a@b.c": "mailto:a@b.c", "?p=2": "https://x.gov/a/Bids.aspx?p=2", "": base, "../../..": "https://x.gov/",
             "#top": "https://x.gov/a/Bids.aspx?q=1#top"}
    assert run(spark, list(cases), lambda c: urls.url_join(F.lit(base), c)) == list(cases.values())
    assert run(spark, ["b"], lambda c: urls.url_join(F.lit("https://x.gov"), c)) == ["https://x.gov/b"]
    assert run(spark, ["https://WWW.A.gov:80/x", "b.com/p", "http://u@c.org"], urls.host_of) == ["a.gov", "b.com", "c.org"]
    assert run(spark, ["https://www.sam.gov/x", "https://notsam.gov", "https://a.opengov.com"],
               urls.is_aggregator_url) == [True, False, True]
    plat = {"https://a.gov/Bids.aspx": "civicplus", "https://x.bonfirehub.com/y": "bonfire",
            "https://ci.town.mo.us/purchasing": "agency", "https://a.com/bids": ""}
    assert run(spark, list(plat), urls.identify_platform) == list(plat.values())
    got = run(spark, ["https://p.gov/1", "https://made.up/1", "/r", "", "mailto:x"], lambda c: urls.resolve_url(
        c, F.lit("https://p.gov/l"), F.lit("see https://p.gov/1 now")))
    assert got == ["https://p.gov/1", "https://p.gov/l", "https://p.gov/r", "https://p.gov/l", "https://p.gov/l"]


def test_places(spark):
    cases = {"City of O'Fallon": "O'Fallon", "Aurora R-VIII School District": "Aurora",
             "Greene County Road District 3": "Greene County", "City of ": "", "The Village of Rye,": "Rye"}
    assert run(spark, list(cases), places.normalize_place) == list(cases.values())
    got = run(spark, ["Bentonville, AR", "Aurora, Missouri", "Aurora", "Paris, France", "San Juan, puerto rico"],
              places.split_city_state)
    assert [tuple(g) for g in got] == [("Bentonville", "AR"), ("Aurora", "MO"), ("Aurora", ""), ("Paris", ""), ("San Juan", "")]
    assert run(spark, ["Missouri", "mo", "Miss", " puerto  rico "], places.state_code) == ["MO", "MO", "", "PR"]
    assert run(spark, ["Cairo, Illinois", "Aurora, IL", "Rome"], lambda c: places.clean_city_label(c, F.lit("IL"))) == [
        "Cairo", "Aurora", "Rome"]
    assert run(spark, ["Greene County", "Wayne Township", "Nixa"], places.entity_type) == ["County", "Township", "City"]


def test_money_keys_leads(spark):
    assert run(spark, ["$1.2M", "$85k", "$45,000", "", "call for pricing"], money.parse_value) == [
        1200000.0, 85000.0, 45000.0, -1.0, -1.0]
    got = spark.createDataFrame([(1200000.0,), (3000000.0,), (85500.0,), (85000.0,), (12.5,)], "n double").select(
        money.format_money("n")).collect()
    assert [r[0] for r in got] == ["$1.2M", "$3M", "$85.5k", "$85k", "$12"]
    pairs = [("General Contractor", "Highland", "builder"), ("", "", "open"), ("", "Jane Doe", "open"),
             ("Concrete builder", "ABC", "taken"), ("Plumber", "P", "unknown")]
    df = spark.createDataFrame(pairs, "t string, n string, e string")
    assert all(r[0] == r[1] for r in df.select(leads.classify_lead("t", "n"), "e").collect())
    assert run(spark, ["ABC Concrete LLC", "Joe Homebuilder", "Sam"], leads.guess_trade) == ["concrete", "builder", ""]
    import hashlib
    want = hashlib.sha256(b"Aurora|T|D|U").hexdigest()[:16]
    assert run(spark, ["T"], lambda c: keys.bid_signature(F.lit("Aurora"), c, F.lit("D"), F.lit("U"))) == [want]


def test_score(spark):
    now = F.lit("2026-08-01").cast("timestamp")
    rows = spark.createDataFrame([
        ("Open", "2026-08-11", "ADA ramp", "a@b.c", "$5"), ("Closed", "2026-08-11", "x", "", ""),
        ("Open", "2026-07-01", "curb", "", ""), ("Open", "", "x", "", "")],
        "s string, d string, t string, e string, v string")
    got = rows.select(relevance.fit_score("s", dates.parse_deadline("d"), "t", F.lit(""), "e", F.lit(""), "v", now))
    assert [r[0] for r in got.collect()] == [20 + 4 + 3 + 1, -100, -50 + 2, 0]


def test_geo(spark):
    r = spark.range(1).select(
        geo.haversine_mi(F.lit(37.2), F.lit(-93.3), F.lit(38.6), F.lit(-90.2)).alias("d"),
        F.size(geo.ring_points(F.lit(37.2), F.lit(-93.3), F.lit(125))).alias("n"),
        F.size(geo.ring_points(F.lit(37.2), F.lit(-93.3), F.lit(50))).alias("m"),
        geo.ring_points(F.lit(37.2), F.lit(-93.3), F.lit(30)).alias("none")).first()
    assert abs(r.d - 195.5) < 3 and r.n == 6 and r.m == 2 and r.none is None


def test_trial(spark):
    now = F.lit("2026-08-10 12:00:00").cast("timestamp")
    got = run(spark, ["2026-08-09 12:00:00", "2026-08-03 12:00:00", "2026-08-03 11:59:59"],
              lambda c: dates.trial_days_left(c.cast("timestamp"), now))
    assert got == [7, 1, 0]
