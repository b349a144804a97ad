"""Spark sessions with the settings that the library's results rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, spark-submit sets master, memory and shared folders."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:  # Python workers import the library too
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in [ROOT, *paths] if x)
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
