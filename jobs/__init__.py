"""Runnable jobs: `python -m jobs.<name> --config jobs/<name>.json`. Each module has run(spark, ...), which the command line calls with a session of its own."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable


def main(run: Callable, doc: str, parameters: dict[str, type]) -> None:
    """Reads the parameters from the configuration file, where the command line doesn't name them, and calls run(spark, **parameters)."""
    from pyspark.sql import SparkSession

    cli = argparse.ArgumentParser(description=doc.splitlines()[0])
    cli.add_argument("--config", help="JSON file with any of the parameters below")
    for name, kind in parameters.items():
        cli.add_argument(f"--{name.replace('_', '-')}", type=kind)
    given = vars(cli.parse_args())
    at = given.pop("config")
    config = {}
    if at:
        with open(at) as f:
            config = json.load(f)
    if unknown := set(config) - set(parameters):
        cli.error(f"unknown in {at}: {', '.join(sorted(unknown))}")
    config |= {k: v for k, v in given.items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **config)
    finally:
        spark.stop()
