"""Scans: every source becomes a DataFrame with a declared schema; blanks stay blanks and nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def text_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """All columns as strings, quoted fields over several lines allowed, blanks kept as blanks."""
    raw = spark.read.schema(_strings(columns)).options(header=True, multiLine=True, quote='"', escape='"', sep=sep, encoding="UTF-8", enforceSchema=True, mode="PERMISSIVE").csv(path)
    return raw.fillna("", list(columns))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def nested_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON document, gzip or not, that may span lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def columns_of(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def bulk_filter(df: DataFrame, dates: tuple[str, str] | None = None, date_col: str = "", isin: dict[str, Sequence[str]] | None = None, contains: dict[str, str] | None = None, non_blank: Sequence[str] = ()) -> DataFrame:
    """The rows of a bulk source that a pull asks for, as one lazy predicate that reaches the scan."""
    test = F.lit(True)
    if dates:
        test &= (F.col(date_col) >= dates[0]) & (F.col(date_col) <= dates[1])
    for c, values in (isin or {}).items():
        test &= F.col(c).isin(*values)
    for c, part in (contains or {}).items():
        test &= F.contains(F.lower(c), F.lit(part.lower()))
    for c in non_blank:
        test &= F.trim(c) != ""
    return df.filter(test)


def inventory(df: DataFrame, source: str, key: str, text: str, date: str) -> DataFrame:
    """Rows, distinct keys, rows with text, and date range by source."""
    return df.groupBy(source).agg(
        F.count("*").alias("rows"), F.countDistinct(key).alias("unique_ids"), F.count(F.when(F.trim(text) != "", 1)).alias("with_text"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )


def decode_labels(df: DataFrame, label_id: str, names: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Label ids turned to names, for a subset of the names. names: label_id, label."""
    return df.join(names.filter(F.col("label").isin(*wanted)), label_id)


def parse_time(value: Column, formats: Sequence[str]) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, status, role) of a JSON registry with a list of entries, each with roles."""
    schema = "entries array<struct<name: string, status: string, roles: array<string>>>"
    entries = nested_json(spark, path, schema).select(F.explode("entries").alias("e"))
    return entries.select("e.name", "e.status", F.explode("e.roles").alias("role"))
