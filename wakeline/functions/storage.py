"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a folder of this machine, set once, if all of Spark runs here;
    on a cluster that is an error, as other machines would not see the files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wakeline-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, hint: str = "table") -> str:
    """A path in the shared folder that nothing has been written to; forget deletes what is written there."""
    path = f"{shared_dir(spark)}/wakeline-{hint}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def settle(df: DataFrame, hint: str = "table") -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, later uses see the same rows and any machine may
    be lost."""
    path = fresh_path(df.sparkSession, hint)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Deletes the tables that settle has written in this process, once no result that reads them is needed any more;
    returns how many there were."""
    jvm, n = spark._jvm, len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
