"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sheavework.plans import all_queries  # noqa: E402
from sheavework.session import build_session  # noqa: E402

HEADLINE = [
    "chunk_words", "chunk_paragraphs", "headings_from_font_size", "embed", "knn_exact", "knn_approx", "search_text",
    "score_tables", "match_rows", "render_snippets", "resources_for_query", "sheet_stats", "upsert_columns",
    "upsert_chunks", "transcript", "append_messages", "export_sessions", "chat_messages", "select_star_join",
    "select_frames", "stream_ingest",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    # Ingest of the stored tables and start of the Python workers are timed on their own.
    started = time.time()
    queries["list_tables"](spark, sf).count()
    times = {"ingest_tables": round(time.time() - started, 3)}
    started = time.time()
    queries["search_text"](spark, sf).count()
    times["ingest_text_and_first_search"] = round(time.time() - started, 3)
    for name in wanted:
        spent = []
        for _ in range(runs + 1):
            started = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            spent.append(time.time() - started)
        times[name] = round(statistics.median(spent[1:]), 3)
        print(name, [round(s, 2) for s in spent], file=sys.stderr, flush=True)
    total = sum(times.values())
    print(json.dumps({"metric": "ingest and headline queries, median of warm runs", "value": round(total, 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
