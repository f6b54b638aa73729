"""Session settings for running the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffle at run time from the bytes written, so the
# partition count below is an upper bound on a laptop and only a start on a cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # call sites of column expressions are not recorded: that takes a third of a query's set-up
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # tables stored by contract also join by tenant and contract without an exchange
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(name: str = "marginflow", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the engine's settings; extra settings use ``__`` for dots.

    Without a master the launcher decides, as on a cluster.
    """
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
