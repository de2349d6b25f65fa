"""Session construction with the settings every plan in this package assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session; on a cluster use the submitted one, which all operators take as argument."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace").config("spark.driver.memory", memory)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
