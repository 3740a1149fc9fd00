"""Headline jobs at one scale: seconds per query, one JSON line."""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from noticegrid import session  # noqa: E402
from noticegrid.workload import catalog  # noqa: E402

HEADLINE = [
    "b1_scan", "b4_alerts", "a11_feed_audit", "w16_posting_segments", "j1_within_radius", "a5_coverage", "j6_place_bids",
    "j9_snap_city", "j8_authority_elsewhere", "b5_postings_from_pages", "b12_details_from_pages", "c1_parse_deadline",
    "c9_html_to_text", "a1_dedupe_bids", "w2_rank_within_city", "b6_discover_portals", "b9_prospects", "b3_residential_leads",
    "t3_portal_health", "a17_entitlements",
]


def laid_out(spark, folder: str, files: int) -> str:
    """The tables over several files each, as a cluster holds them; a one-file table is one task, whatever the cores. Not timed."""
    target = tempfile.mkdtemp(prefix="bench-")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        spark.read.parquet(path).repartition(files).write.parquet(f"{target}/{os.path.basename(path)}")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    cores = int(cpus) if cpus.isdigit() else 8
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * cores), "spark.sql.files.minPartitionNum": str(cores), "spark.ui.enabled": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    tables = laid_out(spark, folder, cores)
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
        session.drop_staged(spark)
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
