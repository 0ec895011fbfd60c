"""Headline queries timed on local Spark; prints one JSON line.

Protocol: one warm-up, then the median of ``BENCH_REPEATS`` runs per query, results
forced with the noop writer. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortspark.catalog import CATALOG  # noqa: E402
from cohortspark.session import build_session  # noqa: E402

HEADLINE = (
    "union_tagged", "sentinel_null", "parse_response", "missing_counts", "row_totals", "zscore",
    "items_long_likert", "items_long_slider", "subscales_wide", "score_type_long",
    "left_join_chain", "attach_covariate", "full_join_reduce", "semi_keep", "dedup_latest",
    "dedup_keep_first", "lead_next_event", "score_summary", "score_two_keys", "reverse_code",
    "survey_round", "survey_followup", "mask_incomplete", "demographics", "normalise_trials",
    "combine_trials", "complete_blocks", "timeout_rules", "rt_quantile", "slider_profile",
    "qc_profile", "qc_keep", "qc_roster", "complete_cases", "model_frame", "design_matrix",
    "ols_by_group", "subject_slopes", "pca_variance", "pca_scores", "glm_binomial",
    "lmm_fixed_effects", "lmm_random_effects", "lmm_slope_model", "glmm_binomial", "bind_rounds",
    "pca_input", "ols_collinear",
)


def run(spark, name: str, folder: str) -> float:
    """Seconds from building the query to its last row."""
    start = time.perf_counter()
    CATALOG.queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in wanted:
        run(spark, name, folder)
        seconds[name] = round(
            statistics.median(run(spark, name, folder) for _ in range(repeats)), 3
        )
    report = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cores": cpus,
        "spark": spark.version,
        "shuffle_partitions": cpus,
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
