"""Time the headline queries; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``. The tables come as
files of one row group, which one task reads; they are first written anew as tables of
several files, as any large table is, outside the time taken. Each query is run
once to warm up and then ``BENCH_RUNS`` times; the median counts. Results go to
the ``noop`` sink, so every row is computed and none is brought to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quirelake.plans import catalog
from quirelake.session import build_session, work_folder

HEADLINES = (
    "S1_read_corpus", "X13_layout_words_documents", "W5_span_offsets", "A0_search", "A1_search_counts", "J13_search_many",
    "J4_hit_to_span", "W10_number_hits", "W3_next_prev_hit", "J2_words_in_box", "J3_redact", "W6_group_lines",
    "T2_geometric_text", "A10_detect_tables", "W1_page_offsets", "W2_pages_seen", "O1_merge_documents", "J12_reorder_pages",
    "S5_export_html", "A3_document_inventory", "A6_content_bbox", "A8_validate", "A11_distinct_documents", "O3_changed_lines",
    "T3_outline_flatten", "U3_replay", "X14_pixel_filters", "X29_markup_links", "J10_effective_layers", "W4_recent_files",
    "R2_debounce_queries", "R5_dedupe_requests", "R6_drop_stale_replies", "R7_upsert_recents", "R8_latest_results",
    "R10_reload_on_change", "T1_fuzzy_find", "J17_verify_digests", "W9_edit_pages",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    tables = work_folder(spark, "bench")
    for table in sorted(Path(folder).glob("*.parquet")):
        spark.read.parquet(str(table)).repartition(2 * int(cpus)).write.parquet(f"{tables}/{table.name}")

    def once(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINES:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
