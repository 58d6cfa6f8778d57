"""Tables that one plan reads several times, kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where the session names none, a session in one process, as in tests, gets a temporary
    one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-zonestudy-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/zonestudy/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: worked out once, whoever reads it, and safe from lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
