"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Only a local session gets a folder of its own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trialframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return f"{p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip('/')}/trialframe/{uuid.uuid4().hex}/{name}"
