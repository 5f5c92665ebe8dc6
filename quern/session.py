"""Session settings that the engine's results depend on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def sound(spark: SparkSession) -> SparkSession:
    """Spark 4.1 lets a union pass on its children's partitioning; rankings that were united and then fused came out
    wrong with it (a test holds such a plan against the plain sum), so it stays off. Python workers can import this
    package wherever the driver was started."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))
    return spark


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in ``spark.checkpoint.dir``; where that is unset and all tasks run in
    the driver's process (tests), a local one. It goes when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quern-')}"
    path = f"{base.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
