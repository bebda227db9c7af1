"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores. Results
are computed in full and discarded (`noop`), after one warm-up query.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from caselog.catalog import QUERIES
from caselog.session import clear_scratch, local_session

HEADLINE = [
    "bin_cutoff", "bin_two_phase", "bin_two_phase_report", "bin_share_report",
    "dist_small_values", "suggest_q_bins_qty", "pair_scores_qty", "best_params_duration_min",
    "auto_binning", "smart_binning_preserve", "smart_binning_standard", "enhanced_binning",
    "term_freq", "tfidf_minmax", "duration_embedding", "feature_embedding", "embedding_slots",
    "onehot_masked", "median_minmax", "event_vector", "word_index", "text_sequence",
    "sequences", "padded_sequences", "encode_events", "duration_embedding_layer",
    "stack_simultaneous", "encode_events_concurrent", "step_mask",
    "first_non_null_case_table", "assemble_inputs", "stratified_split", "tail_split",
    "classification_report", "cross_entropy", "flatten_sequences", "fit_outcome",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
