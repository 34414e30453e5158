"""Session construction with the settings every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings the library relies on; anything the caller passes wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "tidelens", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a UTC session; keyword names use ``__`` for dots (``spark__ui__enabled``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
