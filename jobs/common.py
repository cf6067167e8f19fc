"""What both jobs share: config files, the shared folder, the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession

from stormlake.sources.shared import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder of the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def config_of(kind: type, path: str | None, given: dict[str, object]) -> object:
    """A config from its file and from what the command line gives over it; unknown names are an error."""
    held = json.loads(Path(path).read_text()) if path else {}
    held |= {k: v for k, v in given.items() if v is not None}
    known = {f.name for f in fields(kind)}
    if unknown := set(held) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**held)


def command(kind: type, job: Callable[[SparkSession, object], dict], name: str, argv: list[str] | None = None) -> dict:
    """Run a job from the command line: it alone creates and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=job.__doc__)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")))
    for f in fields(kind):
        parser.add_argument("--" + f.name.replace("_", "-"), type={"int": int, "float": float}.get(str(f.type), str))
    given = vars(parser.parse_args(argv))
    config = config_of(kind, given.pop("config"), given)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return job(spark, config)
    finally:
        spark.stop()
