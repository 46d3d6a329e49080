"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("kinfold.jobs")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file, which may lie in any store that Spark reads."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def settings(given: dict | None, defaults: dict) -> dict:
    """The defaults with what was given; a name that isn't among them is an error."""
    if odd := set(given or {}) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(odd)}")
    return defaults | (given or {})


def command_line(name: str, arguments: dict[str, str], job: Callable) -> None:
    """Run ``job(spark, *arguments, config)`` in a session of its own."""
    p = argparse.ArgumentParser(prog=name, description=job.__doc__)
    for a, says in arguments.items():
        p.add_argument(f"--{a}", required=True, help=says)
    p.add_argument("--config", help="a JSON file of settings")
    given = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        job(spark, *(getattr(given, a) for a in arguments), read_config(spark, given.config) if given.config else None)
    finally:
        spark.stop()
