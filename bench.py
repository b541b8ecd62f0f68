"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from strandweave import catalog
from strandweave.session import local_session

HEADLINE = ("read_routing_flags", "cigar_fold_segments", "mate_pairing", "split_adjacent_segments", "interval_bin_join", "two_sided_match", "breakpoint_cluster", "coverage_rle", "window_depth_mean", "filter_and_vote", "call_deletion", "call_duplication", "order_rank_aggregation", "info_parse", "merge_reciprocal_overlap_pairs", "gc_entropy", "call_end_to_end")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, max(8, 2 * int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    found["read_routing_flags"](spark, sf_dir).count()  # starts the engine
    took = {}
    for name in HEADLINE:
        t = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir}))


if __name__ == "__main__":
    main()
