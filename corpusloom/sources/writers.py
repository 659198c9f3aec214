"""Sinks. Jobs commit as a whole, so a reader never sees half a table."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.relational import same_rows
from corpusloom.sources.readers import file_table


def without_texts(df: DataFrame, key: str, texts: Sequence[str]) -> DataFrame:
    """What may leave the private side: no texts, and the hash of the id in place of the id."""
    return df.withColumn(f"{key}_sha256", F.sha2(F.col(key).cast("string"), 256)).drop(key, *texts)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("errorifexists").options(header=True, quote='"', escape='"', emptyValue="", sep=sep).csv(path)


def write_json_lines(df: DataFrame, path: str, sort_keys: bool = False) -> None:
    (df.select(*sorted(df.columns)) if sort_keys else df).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Write unless the same rows are there already; other rows there raise. True if written."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        if not same_rows(spark.read.schema(df.schema).parquet(path), df):
            raise FileExistsError(f"{path} holds other rows")
        return False
    write_parquet(df, path)
    return True


def write_routed(df: DataFrame, route: str, path: str) -> None:
    """One folder a route in one pass."""
    df.write.mode("errorifexists").partitionBy(route).json(path)


def manifest(df: DataFrame, path: str) -> dict:
    """Files with sizes and hashes, and the number of rows, as read again from what was written."""
    files = file_table(df.sparkSession, f"{path}/part-*").orderBy("path").collect()  # a row a file
    return {"rows": df.sparkSession.read.schema(df.schema).parquet(path).count(), "files": [{"name": f["path"].rsplit("/", 1)[-1], "size": f["size"], "sha256": f["sha256"]} for f in files]}


def manifest_json(parts: dict[str, dict]) -> str:
    return json.dumps(parts, ensure_ascii=False, sort_keys=True, indent=2)


def reading_copy(df: DataFrame, key: str, text: str, size: int = 30_000) -> DataFrame:
    """(key, part, parts, text): long texts in parts that a sheet can hold."""
    parts = df.select(key, X.chunks(F.coalesce(F.col(text), F.lit("")), size).alias("c"))
    return parts.select(key, F.size("c").alias("parts"), F.posexplode("c").alias("part", text))


def redelimit(df: DataFrame, path: str) -> DataFrame:
    """Write as comma-separated and read again; raises unless the rows are the same."""
    from corpusloom.sources.readers import text_csv

    write_csv(df, path)
    again = text_csv(df.sparkSession, path, df.columns)
    if not same_rows(df, again):
        raise ValueError("the rows changed on the way")
    return again


def clipped(value: Column, top: Column) -> Column:
    return F.least(value, top)
