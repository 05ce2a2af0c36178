"""What the command lines of the jobs share: arguments, configuration, session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def defaults(module_file: str) -> dict:
    """The configuration that lies beside a job's module."""
    return json.loads(Path(module_file).with_suffix(".json").read_text())


def checked(own: dict, given: dict) -> dict:
    """own with the settings given in their place; one of an unknown name or another type is an error."""
    for key, value in given.items():
        if key not in own:
            raise ValueError(f"unknown setting: {key}")
        if type(value) is not type(own[key]) and not (isinstance(own[key], float) and type(value) is int):
            raise ValueError(f"{key}: {value!r} is no {type(own[key]).__name__}")
    return own | given


def main(name: str, paths: tuple[str, ...], run: Callable, own: dict, argv=None) -> None:
    """Parse the paths, read the configuration (through Spark: it may lie anywhere), and run the job in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="JSON file; settings left out keep their defaults")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        given = json.loads(spark.read.option("wholetext", True).text(args["config"]).first()[0]) if args["config"] else {}
        run(spark, *[args[p] for p in paths], checked(own, given))
    finally:
        spark.stop()
