"""Times the headline queries on a warm session; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores. Each query runs once to compile and
then BENCH_RUNS times (default 1); the best counts. The history_* queries are whole searches of generated, packed
load_* is the part of it until commits are read.
"""

from __future__ import annotations

import json
import os
import random
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from palimpsest.sinks.gitpack import History

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = (
    "search_history", "search_regex", "search_fixed", "search_ignore_case", "blob_prefilter", "max_count", "context_groups", "introducing_commit", "count_sink",
    "tree_diff", "merge_suppression", "glob_last_wins",
)
# commits, files, share of blobs that repeat
HISTORIES = {"150x30_unique": (150, 30, 0.0), "150x30_reuse90": (150, 30, 0.9), "100x20": (100, 20, 0.5), "500x50": (500, 50, 0.5),
    "1000x100": (1000, 100, 0.5)}


WORDS = "amber basin cedar delta ember fjord grove haven inlet juniper knoll lagoon meadow notch orchard prairie quarry ridge summit tundra".split()


def repository(folder: str, commits: int, files: int, reuse: float) -> str:
    """A linear history, packed. A commit writes a fifth of the files, drawn at random; a share of the texts comes from a
    small stock, the others are new."""
    draw, made = random.Random(f"{commits} {files} {reuse}"), History(folder)
    paths = [f"{draw.choice(WORDS)}/{draw.choice(WORDS)}_{k}.rst" for k in range(files)]
    prose = lambda: "\n".join(" ".join(draw.choices(WORDS, k=9)) for _ in range(6)) + f"\nlandmark {draw.getrandbits(40):x}\n"
    stock = [prose() for _ in range(12)]
    before: tuple = ()
    for k in range(commits):
        for path in draw.sample(paths, max(1, files // 5)):
            made.change(path, made.put("blob", (draw.choice(stock) if draw.random() < reuse else prose()).encode()))
        before = (made.commit(1_500_000_000 + 3600 * k, f"edition {k}", *before),)
    made.ref("refs/heads/main", before[0])
    made.close()
    return folder


def timed(run) -> float:
    best = float("inf")
    for k in range(RUNS + 1):
        t = time.perf_counter()
        run()
        if k:
            best = min(best, time.perf_counter() - t)
    return round(best, 3)


def main() -> None:
    from palimpsest.options import SearchOptions
    from palimpsest.plans import catalogue
    from palimpsest.plans.engine import from_git, search

    began = time.perf_counter()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory",
            "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes",
            "16m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter() - began
    queries, times = catalogue.queries(), {}
    for name in HEADLINE:
        print(name, round(time.perf_counter() - began), file=sys.stderr, flush=True)
        times[name] = timed(lambda: queries[name](spark, SF).write.format("noop").mode("overwrite").save())
    folder = tempfile.mkdtemp(prefix="bench-")
    options = SearchOptions(("landmark",), count=True, color="never")
    count = lambda source: search(spark, source, options).out().write.format("noop").mode("overwrite").save()
    try:
        for name, shape in HISTORIES.items():
            path = repository(f"{folder}/{name}", *shape)
            print(name, round(time.perf_counter() - began), file=sys.stderr, flush=True)
            times[f"load_{name}"] = timed(lambda: from_git(spark, path, {}))
            times[f"history_{name}"] = timed(lambda: count(from_git(spark, path, {})))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    total = sum(t for name, t in times.items() if not name.startswith("load_"))
    print(json.dumps({"metric": "headline queries, best of runs on a warm session", "value": round(total, 3), "unit": "sec", "queries": times, "sf": SF,
        "session_start": round(start, 2)}))


if __name__ == "__main__":
    main()
