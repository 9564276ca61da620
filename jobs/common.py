"""What the jobs share: configuration read through Spark, the command line, the log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("tessella.jobs")


def load_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object at a path that Spark can read; a key that the job doesn't know is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def command_line(about: str, run: Callable[..., DataFrame], defaults: dict, more: dict[str, str], argv: list[str] | None = None) -> None:
    """Parses paths, makes the session, runs the job and stops the session."""
    from tessella.session import session

    parser = argparse.ArgumentParser(description=about)
    for name, text in {"tables": "folder of the input tables", "out": "folder of the output", "config": "JSON file of settings"}.items():
        parser.add_argument(f"--{name}", required=name != "config", help=text)
    for name, text in more.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--master", help="Spark master; by default the submitted session's")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(args.master)
    try:
        config = load_config(spark, args.config, defaults) if args.config else dict(defaults)
        run(spark, args.tables, args.out, *[getattr(args, name) for name in more], config=config)
    finally:
        spark.stop()
