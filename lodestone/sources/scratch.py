"""Written copies of intermediate rows in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder in the warehouse, or, if
    all runs on one machine (a local master, as in tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="lodestone-")
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lodestone-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders that stash has written in this process and nothing has deleted yet, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, files outlive any executor.

    Unlike an RDD checkpoint the copy keeps column pruning and its size, which the planner uses to choose joins. A copy lasts
    until release, or until the process ends. Driver's garbage is collected after each copy: between collections its heap
    grows to several times what is live in it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def release(*stashed: DataFrame) -> None:
    """Delete copies that stash has returned and that no later step reads: what was made of them must have been written."""
    for df in stashed:
        _delete(df._stash_path)
        spark = df.sparkSession
    tidy(spark)


def written_bytes(stashed: DataFrame) -> int:
    """What a copy that stash has returned takes in the shared folder."""
    spark = stashed.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(stashed._stash_path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the session may have ended before the process
            _delete(path)
