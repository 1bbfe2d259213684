"""Time the headline queries; print one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stylograin.catalog import all_queries  # noqa: E402
from stylograin.session import local_session  # noqa: E402

HEADLINE = [
    "g01_detection_by_generator", "g05_generator_language_matrix", "g08_proportional_sample",
    "a03_mean_length_per_language_and_class", "a04_describe_length", "a05_duplicate_count", "a11_box_summary",
    "j01_leakage", "m11_full_metric_row", "m13_group_breakdown", "m15_roc_curve", "m18_best_f1",
    "f17_surface_features", "t02_words_and_bigrams", "t03_char_ngrams", "t05_vocabulary", "t09_tfidf",
    "t10_coverage_by_language", "t12_class_means_per_language", "w04_top_k_per_language", "tr11_shape_features",
    "tr14_transitions", "tr18_path_tfidf", "ar3_padded_and_mask", "ar8_softmax", "ml03_balanced_logistic_regression",
    "ml12_permutation_importance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app_name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{folder}/documents.parquet").groupBy("lang").count().collect()  # start the JVM's engines
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:45s} {seconds[name]:8.2f}", file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
