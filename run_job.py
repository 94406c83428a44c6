"""Command line for the jobs, to be given to spark-submit.

    spark-submit run_job.py grid --fires FIRES --out GRID
    spark-submit run_job.py stations --out MAPPING
    spark-submit run_job.py import --daily-files CSV_FOLDER --history HISTORY
    spark-submit run_job.py refresh --payloads LANDED --mapping MAPPING --grid GRID \
        --history HISTORY --out RESULTS --run-ts '2024-07-01 06:00:00'
    spark-submit run_job.py ingest --payloads LANDED --mapping MAPPING --history HISTORY --checkpoint STATE
    spark-submit run_job.py score --history HISTORY --grid GRID --out RESULTS --run-ts ... [--as-of 2024-07-01]
    spark-submit run_job.py prune --history HISTORY [--keep 45]
    spark-submit run_job.py health --history HISTORY --out RESULTS --run-ts ...
    spark-submit run_job.py stats --history HISTORY --out RESULTS
    spark-submit run_job.py classes
"""

from __future__ import annotations

import argparse
from datetime import date, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from emberline.constants import WINDOW_DATES
from emberline.functions.classify import danger_classes
from emberline.operators.report import training_records
from emberline.plans import jobs
from emberline.sources import payloads, sinks, weather
from emberline.sources.payloads import local_date_text
from emberline.streaming import ingest

JOBS = ["grid", "stations", "import", "refresh", "ingest", "score", "prune", "health", "stats", "classes"]


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser()
    parser.add_argument("job", choices=JOBS)
    for name in ("fires", "payloads", "mapping", "grid", "daily-files", "history", "out", "checkpoint"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--run-ts", help="time of the run, in UTC")
    parser.add_argument("--as-of", help="date of the snapshot to score, by default the newest")
    parser.add_argument("--keep", type=int, default=WINDOW_DATES, help="number of dates to keep")
    parser.add_argument("--mode", default="circle", choices=["circle", "polygon64"])
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName(f"emberline-{args.job}").getOrCreate()
    run_at = datetime.fromisoformat(args.run_ts) if args.run_ts else None
    grid = weather.read_grid(spark, args.grid) if args.grid and args.job != "grid" else None

    if args.job == "grid":
        jobs.build_grid(spark, weather.read_fires(spark, args.fires), args.out, args.mode)
    elif args.job == "stations":
        jobs.map_stations(spark, args.out)
    elif args.job == "import":
        sinks.write_daily(weather.load_history(spark, args.daily_files), args.history)
    elif args.job == "refresh":
        local = spark.range(1).select(local_date_text(F.lit(args.run_ts).cast("timestamp"))).first()[0]
        jobs.refresh(
            spark, payloads.read_payloads(spark, args.payloads), weather.read_mapping(spark, args.mapping), grid,
            args.history, args.out, run_at.date(), local, args.run_ts, args.keep,
        ).show(truncate=False)
    elif args.job == "ingest":
        stream = payloads.stream_payloads(spark, args.payloads)
        mapping = weather.read_mapping(spark, args.mapping)
        ingest.start_ingest(stream, mapping, args.history, args.checkpoint).awaitTermination()
        sinks.prune_history(spark, args.history, args.keep)
    elif args.job == "score":
        as_of = date.fromisoformat(args.as_of) if args.as_of else None
        jobs.score_stored(spark, args.history, grid, args.out, args.run_ts, as_of).show(truncate=False)
    elif args.job == "prune":
        print(*sinks.prune_history(spark, args.history, args.keep))
    elif args.job == "health":
        history = weather.if_present(lambda: weather.read_history_table(spark, args.history))
        stored = weather.if_present(lambda: spark.read.parquet(f"{args.out}/predictions/parquet"))
        jobs.health(spark, history, stored, args.run_ts).show(truncate=False)
    elif args.job == "stats":
        records = training_records(spark.read.parquet(f"{args.out}/run_log"))
        records.withColumn("dates", F.lit(len(weather.partition_dates(spark, args.history)))).show()
    else:
        danger_classes(spark).orderBy("class_ord").show(truncate=False)


if __name__ == "__main__":
    main()
