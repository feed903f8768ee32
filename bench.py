"""Headline queries, timed cold and warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugeframe.plans import QUERIES  # noqa: E402
from gaugeframe.session import local_session  # noqa: E402

HEADLINE = [
    "b01_parse_image_name", "b12_classify_exclusive", "c01_integrate_sources", "d02_mark_units", "d03_mark_group_summary", "d09_color_units_raw",
    "d10_color_units_final", "d13_bb_summary_by_kind", "d15_tick_final_summaries", "e01_stratified_unit_sample", "e15_circular_islands", "e19_anchor_merge",
    "e20_interval_union", "f05_multiset_compare", "g01_bb_compare", "g04_min_cost_color_match", "g05_delta_e00", "g09_family_medoid",
    "g14_select_axis_values", "g15_scale_vote", "g16_slot_consensus", "g18_overall_strict", "g19_ocr_components", "g21_text_score",
    "g22_embedding_similarity", "g26_semantic_questions", "g28_plot_frame_consensus", "g33_overlap_derived", "h10_numeric_token", "a14_emit_by_hash",
]


def run(spark, name: str, sf: str) -> float:
    t = time.perf_counter()
    # every column of every row is computed, nothing is written
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/region.parquet").count()
    cold, warm = {}, {}
    for n in names:
        cold[n] = round(run(spark, n, sf), 3)
        warm[n] = round(run(spark, n, sf), 3)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(sf.rstrip("/")), "cpus": os.environ.get("BENCH_CPUS", "8"),
    }))


if __name__ == "__main__":
    main()
