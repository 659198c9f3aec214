"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.storage import drop_saved as drop_staged
from corpusloom.operators.storage import saved as stage_table
from corpusloom.operators.storage import saved_so_far as staged_so_far

__all__ = ["WS", "drop_staged", "once", "read", "slices", "stage_table", "staged_so_far"]

#: ASCII white space, the word separators of the text contracts: space, tab, LF, VT, FF, CR.
WS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of fewer rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def once(df: DataFrame, **columns) -> DataFrame:
    """Add columns that are computed once a row, however often later expressions name them: a generator of one row keeps the optimizer from inlining them."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
