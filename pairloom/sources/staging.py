"""Tables written on the way, to cut a lineage or to be read more than once.

They live under ``spark.checkpoint.dir``, the folder all executors share, so a lost
executor costs nothing but a re-read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster whose session names no folder that all executors share."""


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the session names; where it names none, one beside the session's warehouse tables.

    A warehouse on a machine's own disk is refused on a cluster: executors would each write to theirs.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own_disk = warehouse.startswith("file:") or "://" not in warehouse
    if own_disk and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_staging"


def staging_path(spark: SparkSession, name: str) -> str:
    """A path in the staging folder that nothing else uses."""
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the table to the staging folder and read it back; options go to the Parquet writer."""
    path = staging_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, path: str) -> None:
    """Delete a staged table once the job that wrote it is through with it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
