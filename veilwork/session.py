"""Session settings the library expects; a cluster's own settings win."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

CALL_SITE_CAPTURE = "spark.python.sql.dataFrameDebugging.enabled"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Plans here are built from thousands of small calls; call-site capture makes that slow.
    CALL_SITE_CAPTURE: "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def without_call_sites(spark: SparkSession) -> None:
    """Turn call-site capture off in a given session, if it still can be.

    It reads the Python stack on every column call, and these plans need thousands.
    """
    try:
        spark.conf.set(CALL_SITE_CAPTURE, "false")
    except PySparkException:
        pass  # fixed at start in this version: slower plan building, same results


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilwork")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
