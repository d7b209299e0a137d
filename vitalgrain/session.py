"""Session factory shared by tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; ``conf`` adds or overrides settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.sql.maxMetadataStringLength": "2000",  # plans show their pushed filters in full
    } | conf
    spark = SparkSession.builder.master(master).appName("vitalgrain").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
