"""Spark session with the settings the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "barwright", master: str | None = None, shuffle_partitions: int | None = None, **extra: str
) -> SparkSession:
    """Session with UTC time, adaptive execution and Arrow.

    On a cluster leave ``master`` unset: spark-submit supplies it.  Set
    ``shuffle_partitions`` to a small multiple of the cores.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        b = b.config(k, v)
    return b.getOrCreate()
