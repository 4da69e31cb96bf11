"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package by the path it has on the driver.

    On a cluster whose nodes don't share that path, install the package or pass it with --py-files.
    """
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root
