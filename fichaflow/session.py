"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Runtime-settable options; everything else is left to the cluster's own defaults.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the options above to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    try:
        # call-site capture doubles the time it takes to build a large plan from Python
        spark.conf.set("spark.python.sql.dataFrameDebugging.enabled", "false")
    except AnalysisException:
        pass  # fixed once the session runs
    return spark


def build_session(app_name: str = "fichaflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
