"""Session settings the operators are written for."""

import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution merges small shuffle partitions, turns joins with a side that proved small at
# run time into broadcast joins and splits skewed partitions of the remaining sort-merge joins.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # no call-site capture for every Column: halves the time to build a query
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app="turnlab", master=None, **extra):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark, what):
    """A new folder below the session's ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a local session takes a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="turnlab-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
