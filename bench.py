"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to the end (rows are produced and dropped by the noop sink), once untimed to compile
its code and once timed, from building the query to the last row.
"""

import json
import os
import sys
import time

os.environ.setdefault("PYTHONWARNINGS", "ignore")

from turnlab.plans.catalog import QUERIES
from turnlab.session import build_session

HEADLINE = [
    "prev_eml_to_outcome_probability", "prev_eml_outcome_test", "joint_condition_to_outcome_probability",
    "act_association", "label_timing", "timing_outcome_test", "confidence_rank_test",
    "confidence_box_by_timing", "transition_table", "transition_summary", "gap_transition_table",
    "transitions_by_act_and_event", "transitions_by_each_act", "transitions_by_last_event_act",
    "nearest_labels", "matching_rate", "conversion_rate", "dialogue_summary", "eml_ratio_by_act",
    "act_frequency", "merged_turns", "numbered_speaker_runs", "conversation_outcomes",
    "cascade_matched_labels", "rater_majority", "act_list_quality", "outcome_quality",
    "word_frequency_by_language", "context_prompts", "sequence_features", "stratified_split_sizes",
    "outcome_rules", "tfidf_weights", "eml_model_quality",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("turnlab-bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("OFF")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(name)
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
