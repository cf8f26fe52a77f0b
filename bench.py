"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Every query is built, planned and run in full into a sink that
drops its rows; the time of a query is the better of two runs.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "changed_lines_by_extension",
    "changed_lines",
    "hunk_lines",
    "comments_by_pull_request",
    "clean_comments",
    "resolve_patches",
    "issue_facts",
    "commented_lines",
    "labelled_lines",
    "prepared_training",
    "prepared_scoring",
    "balanced_classes",
    "roc_and_pr_areas",
    "top_suggestions",
    "scoring_responses",
    "opened_pull_requests",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("prsignal-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="prsignal-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from prsignal.plans.queries import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
