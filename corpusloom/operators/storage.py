"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder. Where both are unset, a temporary folder, on a local master alone: on a cluster executors would write to their own disks."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        inner = context._jsc.sc()
        if inner.getCheckpointDir().isEmpty():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        found = inner.getCheckpointDir().get()
    return found.rstrip("/")


#: Folders that saved has written in this process, in order; "" where one is deleted.
_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, label: str = "files") -> str:
    return f"{shared_folder(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"


def parts_for(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Parts for a table of at most so many rows of that size: of 64 MB, and two a core at least. Only where there are far more shuffle partitions than that does it save anything."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows * row_bytes // (1 << 26)))


def saved(df: DataFrame, label: str = "table", parts: int | None = None) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives the loss of executors and gives later joins real sizes. parts: so many files at most, see parts_for."""
    path = new_folder(df.sparkSession, label)
    df = df if parts is None else df.coalesce(parts)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_so_far() -> int:
    return len(_WRITTEN)


def drop_saved(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete what saved has written in this process, or from the first to before the last of it; results that still read it are lost."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for k in range(first, len(_WRITTEN) if last is None else last):
        if _WRITTEN[k]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN[k])
            path.getFileSystem(hadoop).delete(path, True)
            _WRITTEN[k] = ""
