"""What the operators share: tables in the cluster's shared folder, and slices of Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where the session names none, a session in one process, as in tests, gets a temporary one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-zonestudy-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/zonestudy/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of ``tables`` that ``written`` made, once nothing reads them any more."""
    for df in tables:
        for folder in {m[1] for m in (re.match(r"(.*/zonestudy/[0-9a-f]{32})/", f) for f in df.inputFiles()) if m}:
            jvm, spark = df.sparkSession._jvm, df.sparkSession._jsparkSession
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sessionState().newHadoopConf()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``max_bytes`` in each piece, of 32,768 rows at most; one longer value is a piece of its own.
    After the last one the worker gives back what it no longer needs."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if (held + size > max_bytes and i > start) or i - start == 32_768:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
    release()


def release() -> None:
    """Gives memory that this worker has freed back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may have none
    if trim:
        trim(0)
