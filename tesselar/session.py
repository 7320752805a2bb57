"""Session factory with the settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tesselar", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution. On a cluster the master and the number of partitions come from its own settings."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
