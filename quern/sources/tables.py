"""Reading tables for work that is bound by the CPU."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import sound

SMALL = 64 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A few small files, which may have one row group and so one task each, are spread over the cores;
    anything larger has tasks enough and is not shuffled."""
    df = sound(spark).read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    conf, size = spark._jsc.hadoopConfiguration(), 0
    for f in files:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        size += at.getFileSystem(conf).getFileStatus(at).getLen()
    return df.repartition(cores) if SMALL > size > 1 << 20 else df
