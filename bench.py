"""Times the headline queries and prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from annolytics.plans import load_queries  # noqa: E402
from annolytics.plans.registry import Tables  # noqa: E402
from annolytics.session import local_session  # noqa: E402

HEADLINE = ["document_overview", "b12_sentence_split", "b13_numbering", "a08_listing", "c01_phrase_match", "c06_resolve_ids", "c10_citations",
            "d05_overlaps", "d06_repeated_marks", "d11_figure_bodies", "e02_canonical_numbers", "e10_display_defects", "f02_user_changes",
            "f08_foreign_cleanup", "g02_library_profile", "g03_colour_profile", "g09_spread_sample", "g15_highlight_facts", "h02_message_usage",
            "h03_counter_totals", "h06_run_costs", "h12_turns", "h15_context_gauge", "h20_entries", "h27_baseline_deltas", "s03_usage_windows"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    registry, tables, times = load_queries(), Tables(spark, folder), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        began = time.perf_counter()
        registry[name].build(tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
