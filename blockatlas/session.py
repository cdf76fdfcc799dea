"""Session defaults shared by tests, bench and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "blockatlas", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew handling, Arrow on.

    On a cluster the master, the shuffle partition count and ``spark.checkpoint.dir`` come from
    spark-submit; nothing here overrides them unless passed in ``extra``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
