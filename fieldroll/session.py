"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings win where they are given."""
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).config(map=own).getOrCreate()
