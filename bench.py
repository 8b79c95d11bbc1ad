"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an optional list of names
(``all`` for every query). Every result is computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedweir.plans import all_queries, bound  # noqa: E402
from feedweir.session import build_session  # noqa: E402

HEADLINE = """canonicalize_urls url_identity resolve_sources find_or_create_sources alias_registry upsert_articles clean_text parse_dates
normalize_articles detect_new_articles detect_stats enrich_articles enrichment_batches preview_items content_changes classify_fetches
attempt_durations attempt_lifecycle health_scores shadow_activation poll_batch activate_schema fan_out_deliveries requeue_rules
translation_batches email_digests delivery_outcomes message_payloads source_status_row source_diagnostics user_dashboard
parse_with_fallback_order link_candidates page_metadata article_bodies detect_listing_patterns score_article_candidates
clean_markdown_lines verify_language""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "").split()
    names = all_queries() if asked == ["all"] else asked or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "feedweir-bench",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.feedweir.spread": cpus if cpus.isdigit() else "8",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("classify_fetches", "clean_text"):  # start threads and Python workers, compile code
        bound(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        bound(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
