"""Headline queries on ``$BENCH_SF_DIR``; prints one JSON line.

All queries run three times over their whole results and the median counts, which
is never the first, cold run unless a later one is slower. Model fits run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revana.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "parse_pages", "dedup_reviews", "letter_words", "word_frequency", "top_words", "cloud_weights",
    "stopwords_removed", "document_terms", "word_ids", "bag_of_word_ids", "graph_edges",
    "sentiment_scores", "sentiment_confusion", "sentiment_report", "exclusive_terms",
    "topic_texts", "parsed_topics", "exact_split", "stratified_folds", "scaled_numbers",
    "script_bigrams", "lexicon_words", "dictionary_words",
]
SLOW = ["lda_topics", "shapley_summary"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("revana-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="bench-"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    runs: dict[str, list[float]] = {}
    names = sys.argv[1:] or HEADLINE + SLOW
    for turn in range(3):
        for name in names:
            if name in SLOW and turn > 0:
                continue
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.setdefault(name, []).append(time.perf_counter() - start)
    times = {name: round(statistics.median(t), 3) for name, t in runs.items()}
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
