"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "korpisto.shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Workers that already have it on their path keep their own copy.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getLocalProperty(_SHIPPED):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="korpisto"), "korpisto.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc.setLocalProperty(_SHIPPED, "1")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
