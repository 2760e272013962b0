"""The Spark session that queries, tests and the benchmark use on one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "drawgraph", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster, master and partitions come from its own settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
