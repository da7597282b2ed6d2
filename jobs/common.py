"""What both jobs share: settings from a small JSON file, the command line, sessions and folders."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(default: str, path: str | None = None) -> dict:
    """The settings beside the job, with those of another file on top; a name that the job doesn't know is an error."""
    own = json.loads((Path(__file__).parent / default).read_text())
    more = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(more) - set(own):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return own | more


def main(run: Callable[..., None], default: str, places: list[str]) -> None:
    """Command line: --config and one path for each of places."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    parser.add_argument("--config", help=f"JSON file with settings to use in place of those of {default}")
    for p in places:
        parser.add_argument(f"--{p}", required=True)
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    own = settings(default, args.pop("config"))
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, *[args[p] for p in places], own)
    finally:
        spark.stop()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the one that the session shares; nothing is made yet."""
    from latticeflow.operators.graph import shared_dir

    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, path: str, by: str) -> None:
    """Write df in partitions of `by`, in place of those that it has rows for; large ones in several files."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What put() wrote, in like's types: names of partitions are not guessed at."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)
