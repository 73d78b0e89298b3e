"""Session settings that the results rely on, and those that fit a cluster of any size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("plumbline").config(map=SETTINGS | {k.replace("__", "."): v for k, v in conf.items()})
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    return builder.getOrCreate()


_SHIPPED = "plumbline.shipped"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each session's context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.getLocalProperty(_SHIPPED) != sc.applicationId:
        here = Path(__file__).parent
        target = Path(tempfile.mkdtemp()) / "plumbline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(target))
        sc.setLocalProperty(_SHIPPED, sc.applicationId)
    return spark
