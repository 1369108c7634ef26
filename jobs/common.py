"""What the jobs' command lines share: a session, a log, a config file."""

from __future__ import annotations

import json
import logging
from dataclasses import fields
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def settings_of(kind: type, path: str | None) -> Any:
    """The settings in a JSON file; a key that the job doesn't know is an error, an absent one keeps its default."""
    if path is None:
        return kind()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings in {path}: {sorted(unknown)}")
    return kind(**given)


def session(name: str) -> SparkSession:
    """Only command lines call this; masters and memory come from spark-submit or spark-defaults."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def parquet_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where nothing has been written yet; other faults are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_partitions(df: DataFrame, path: str, *by: str, format: str = "parquet") -> None:
    """Write ``df``, replacing the partitions that it has rows of and leaving the others; the session's own mode stays as it is."""
    df.write.format(format).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).save(path)
