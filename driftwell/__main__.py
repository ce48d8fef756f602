"""Command line: ``python -m driftwell run|compare [--config FILE] [--run-dir DIR]``.

run makes a synthetic stream, keeps it, writes its window statistics to the configured
sinks and compares both; compare repeats the comparison for a run's directory.
"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, load_config
from .plans.windows import compare, nested, window_stats
from .sources.sensors import read_reported_stats, read_sensor_json, synthetic, write_sensor_json
from .sources.sinks import build_sinks, export


def compare_run(spark: SparkSession, run_dir: str, cfg: Config) -> DataFrame:
    """The comparison of a run's stream with its reported statistics, also written to results/compare.jsonl."""
    records = read_sensor_json(spark, f"{run_dir}/data/stream.jsonl")
    report = compare(records, read_reported_stats(spark, f"{run_dir}/results/stats.jsonl"), cfg)
    nested(report).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{run_dir}/results/compare.jsonl")
    return report


def run(spark: SparkSession, cfg: Config) -> str:
    """One window of the synthetic stream from start to comparison; returns the run's directory."""
    sinks, run_dir = build_sinks(cfg)
    stream = synthetic(spark, cfg).orderBy("place")
    write_sensor_json(stream.select("sensor_id", "region", "reading", "confidence", F.create_map(F.lit("note"), F.col("note")).alias("metadata")), f"{run_dir}/data/stream.jsonl")
    records = read_sensor_json(spark, f"{run_dir}/data/stream.jsonl")
    export(sinks, window_stats(records, cfg), f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}")
    compare_run(spark, run_dir, cfg)
    return run_dir


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="driftwell", description=__doc__)
    parser.add_argument("command", choices=("run", "compare"))
    parser.add_argument("--config", help="YAML settings")
    parser.add_argument("--run-dir", help="directory of a run, for compare")
    args = parser.parse_args(argv)
    if args.command == "compare" and not args.run_dir:
        parser.error("compare needs --run-dir")
    cfg = load_config(args.config) if args.config else Config()
    spark = SparkSession.builder.appName("driftwell").getOrCreate()
    if args.command == "run":
        print(run(spark, cfg))
    else:
        compare_run(spark, args.run_dir, cfg).show(truncate=False)


if __name__ == "__main__":
    main()
