"""Intermediate tables in the shared folder of the cluster.

Iterative operators cut their lineage by writing a table and reading it back.
The table lives in the folder that ``spark.checkpoint.dir`` names, which every
executor can reach, so a lost executor never takes a part of it along.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Rows of an intermediate table that are worth a file.
FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only in local mode where none is set (tests).

    Elsewhere a missing setting raises RuntimeError: a folder of the driver's machine is not the executors'.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows or fewer, in no more partitions than one for every ``FILE_ROWS`` of them.

    Tables of many rows keep their partitions. Only the tasks after the last exchange are merged.
    """
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    ``rows`` is about how many it has at most, where that is known: a small table is
    then written as a few files. Each file costs a task and, in Hadoop's local file
    system, processes forked from the executor for its permissions.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if rows is None else packed(df, rows)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove the shuffle files of plans nobody refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
