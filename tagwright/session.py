"""A session with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tagwright", **conf: str) -> SparkSession:
    """Adaptive execution with skew splitting; UTC so that results do not depend on the host.

    ``spark.sql.shuffle.partitions`` is left to the cluster: adaptive execution coalesces
    partitions that turn out small, so a generous number is the safe side. Python workers import
    this package: of a local session they find it where the driver does, on a cluster it is installed
    or sent along (``--py-files``).
    """
    if master and master.startswith("local"):
        home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != home]
        os.environ["PYTHONPATH"] = os.pathsep.join([home, *known])
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
