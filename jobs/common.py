"""What the command lines share: settings from a file, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession


def settings(kind: type, path: str | None):
    """Settings of a JSON file over the defaults; names that are none are refused."""
    data = json.loads(Path(path).read_text()) if path else {}
    if extra := set(data) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return kind(**data)


def command_line(name: str, about: str, paths: dict[str, str], kind: type, run: Callable, argv: list[str] | None = None) -> int:
    """Parses paths (name: help; optional if the help begins with a bracket) and --config, runs the job in a session of its own, stops that."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for k, text in paths.items():
        parser.add_argument(f"--{k.replace('_', '-')}", required=not text.startswith("["), help=text)
    parser.add_argument("--config", help="JSON file of settings", default=None)
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    chosen = settings(kind, args.pop("config"))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **args, settings=chosen)
    finally:
        spark.stop()
    return 0
