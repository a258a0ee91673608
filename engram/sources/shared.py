"""The folder that every executor can reach, for written intermediates."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's checkpoint folder.

    Only a session of one machine and without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/engram-{purpose}-{uuid.uuid4().hex}"


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    The written table has a size Spark knows, so a join with it is planned by
    that size, and it is not worked out again when an executor is lost.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
