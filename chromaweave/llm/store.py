"""Tables cut out of the lineage, kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder of a local session only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="chromaweave-")
    return _LOCAL[app]


#: Folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def materialise(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The files outlive any executor, so what is built on them never recomputes
    ``df`` and never sees another row order than the one that was written.  A task
    holds ``group_bytes`` of rows before it writes them (by default what Parquet does).
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/chromaweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*dfs: DataFrame) -> None:
    """Delete tables made by :func:`materialise` once nothing reads them any more."""
    for df in dfs:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        for folder in {f.rpartition("/")[0] for f in files}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of stages that nothing refers to."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand texts to Python in batches of few rows, so that long ones fit a worker's memory."""
    spark.conf.set(BATCH_ROWS, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Batches of so many rows for what is run inside."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def unused(name: str, columns) -> str:
    """``name``, with underscores behind it until no column is called like it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """In a task: return what earlier tasks of this reused worker left in its allocators to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
