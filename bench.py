"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from edictal.queries import all_queries
from edictal.session import local_session

HEADLINE = (
    "closure_summary", "reconcile", "closure_event", "notice_class", "scope", "clean_title", "class_from_table", "html_text", "tokens",
    "deadline", "enrolment_state", "dedup_news", "transitions", "best_url", "rank_sources", "match_follow_up", "match_by_content",
    "match_call_to_base", "best_notice", "nearest_date", "news_counts", "digests", "diff_all", "fingerprint_plan", "catalogue_list",
    "catalogue_open_now", "my_feed", "new_news", "import_calls", "import_notices", "group_pipeline", "syllabus", "cycle_summary", "track_seen",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    os.environ.setdefault("SPARK_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="edictal-bench-"))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "16g"))
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    # The first query of a session pays for class loading; it is run once over the smallest tables.
    small = os.path.join(os.path.dirname(path.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        queries["closure_summary"](spark, small).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(path.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
