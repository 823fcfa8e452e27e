"""What both jobs share: configuration, log and session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("jobs")


def settings(name: str, path: str | None = None, **changed) -> dict:
    """The job's configuration: its file beside this module, then another file's values, then ``changed``."""
    own = os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json")
    found: dict = {}
    for file in [own] + ([path] if path else []):
        with open(file) as text:
            found |= json.load(text)
    with open(own) as text:
        known = set(json.load(text))
    if odd := sorted(({*found} | {*changed}) - known):
        raise ValueError(f"{name} has no settings {odd}; it has {sorted(known)}")
    return found | changed


def logged(df: DataFrame, what: str, path: str) -> DataFrame:
    """``df``, a table just read or read back, after a line of log with its rows."""
    LOG.info("%s: %d rows, %s", what, df.count(), path)
    return df


def command(name: str, paths: Sequence[str], run: Callable, arguments: list[str] | None = None) -> None:
    """Parse a command line of plain paths, run the job in a session of its own, and stop that."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for path in paths:
        parser.add_argument(path)
    parser.add_argument("--config", help="a JSON file whose values replace those of the job's own")
    parser.add_argument("--scratch", help="a folder shared by the cluster for tables between steps; default: spark.checkpoint.dir of the session")
    parser.add_argument("--master", help="as for Spark; default: that of spark-submit or of its configuration")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.master(given.master) if given.master else builder
    builder = builder.config("spark.checkpoint.dir", given.scratch) if given.scratch else builder
    spark = builder.getOrCreate()
    try:
        run(spark, *(getattr(given, p) for p in paths), settings(name, given.config))
    finally:
        spark.stop()
