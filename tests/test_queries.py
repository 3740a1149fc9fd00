"""Registered queries against their SQL on the smallest scale; CHECK_ALL=1 runs every one."""

import os

import pytest

from noticegrid.workload import check
from noticegrid.workload.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
SHORT = ["b1_scan", "b4_alerts", "j1_within_radius", "j6_place_bids", "j8_authority_elsewhere", "j9_snap_city", "a5_coverage",
         "w16_posting_segments", "s8_feed_items", "s10_extraction_rows", "b12_details_from_pages", "a11_feed_audit", "b7_promote",
         "w4_prioritize_pages", "a23_contacts_per_site", "a17_entitlements", "a18_bonus_days", "j26_suppress_recipients",
         "t3_portal_health_stream", "t7_daily_rate_limit_stream", "t1_stream_new_matches", "j16_leads_in_radius", "s2_read_gazetteer",
         "j30_recall_join", "a13_category_profile", "a16_metro_reach", "s17_append_or_rewrite", "t3_portal_health_resumed", "t5_benches_stream"]


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return check.connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("CHECK_ALL") else SHORT)
def test_query(spark, con, name):
    if name not in ORACLE:
        assert QUERIES[name](spark, FOLDER).count() >= 0
        return
    problem, _ = check.compare(spark, con, FOLDER, QUERIES[name], ORACLE[name])
    assert problem is None


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
