"""Joins, windows and set operations with the checks and orders that curation needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.storage import saved


def join_one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join after a check that no key repeats on either side."""
    for side in (a, b):
        if not side.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"keys repeat: {list(keys)}")
    return a.join(b, list(keys), how)


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    left, right = (d.select(*keys).distinct() for d in (a, b))
    return left.join(right, list(keys), "left_anti").withColumn("side", F.lit("left_only")).union(right.join(left, list(keys), "left_anti").withColumn("side", F.lit("right_only")))


def join_filled(a: DataFrame, b: DataFrame, keys: Sequence[str], fill: dict[str, object]) -> DataFrame:
    return a.join(b, list(keys), "left").fillna(fill)


def anti_all(df: DataFrame, excluded: dict[str, DataFrame]) -> DataFrame:
    """Rows whose value is in none of the excluded lists, each a column's; nulls stay."""
    for column, values in excluded.items():
        df = df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_anti")
    return df


def anti_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anti join on a tuple in which a null equals a null."""
    other = other.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    test = None
    for k in keys:
        same = df[k].eqNullSafe(other[f"__{k}"])
        test = same if test is None else test & same
    return df.join(other, test, "left_anti")


def nth_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__n", rank).filter(F.col("__n") == n).drop("__n")


def first_pair(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """First and second member of each group in one row; groups of one are left out. Two rows a group are ranked, and groups are counted by partial sums."""
    two = top_per_key(df.select(*group, *columns, *[c for c in order if isinstance(c, str) and c not in {*group, *columns}]), group, order, 2)
    at = lambda n, s: two.filter(F.col("rank_in_group") == n).select(*group, *[F.col(c).alias(f"{c}_{s}") for c in columns])
    sizes = df.groupBy(*group).agg(F.count("*").alias("group_size"))
    found = at(1, "a").join(at(2, "b"), list(group)).join(sizes, list(group))
    return found.select(*group, "group_size", *[f"{c}_a" for c in columns], *[f"{c}_b" for c in columns])


def group_size(df: DataFrame, group: Sequence[str], name: str = "group_size") -> DataFrame:
    """The size of each row's group, from partial counts joined back: a large group isn't gathered in one task."""
    sizes = df.groupBy(*group).agg(F.count("*").alias(name))
    renamed = sizes.select(*[F.col(g).alias(f"__{g}") for g in group], name)
    test = None
    for g in group:
        same = df[g].eqNullSafe(renamed[f"__{g}"])
        test = same if test is None else test & same
    return df.join(renamed, test).select(*df.columns, name)


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in a full order; the engine keeps n rows a key and task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("rank_in_group", rank).filter(F.col("rank_in_group") <= n)


def neighbours(df: DataFrame, group: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Each row with the previous and the next row's columns."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns} | {f"next_{c}": F.lead(c).over(w) for c in columns})


def round_robin(df: DataFrame, strata: Sequence[str], key: Column, n: int | None = None) -> DataFrame:
    """Rows in the order: first of each stratum, second of each, and so on; position from 1, at most n. All rows are numbered within sorted ranges, so that no task sees them all."""
    ranked = df.withColumns({"__k": key, "rank_in_stratum": F.row_number().over(Window.partitionBy(*strata).orderBy(key))})
    order = ["rank_in_stratum", *strata, "__k"]
    if n is None:
        return number_rows(ranked, order, "position").drop("__k")
    first = ranked.filter(F.col("rank_in_stratum") <= n).orderBy(*order).limit(n)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order))).drop("__k")


def sequential_ids(df: DataFrame, prefix: str, order: Sequence[Column | str], width: int = 3, name: str = "record_id") -> DataFrame:
    """Ids such as REG-001 in a full order. Rows are numbered within sorted ranges and the ranges' counts added, so no task sees all rows."""
    numbered = number_rows(df, order)
    return numbered.withColumn(name, F.format_string(f"{prefix}-%0{width}d", "row_number")).drop("row_number")


def _ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Sorted ranges, with the range's number and the row's place in it; written once, so that all readers see the same ranges whatever columns they read."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return saved(sorted_rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))


def _before(ranged: DataFrame, total: Column) -> DataFrame:
    """(__p, __before): the total of the ranges before each; a row a range."""
    sums = ranged.groupBy("__p").agg(total.alias("s"))
    return sums.select("__p", F.coalesce(F.sum("s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """Row numbers from 1 in a full order, without a window over all rows."""
    ranged = _ranged(df, order)
    inside = F.col("__i") - F.shiftleft(F.col("__p").cast("bigint"), 33) + 1
    return ranged.join(_before(ranged, F.count("*")), "__p").withColumn(name, F.col("__before") + inside).drop("__p", "__i", "__before")


def running_sum(df: DataFrame, order: Sequence[Column | str], value: str, name: str = "running") -> DataFrame:
    """The sum of all values up to each row in a full order: within sorted ranges, plus the sums of the ranges before."""
    ranged = _ranged(df, order)
    inside = F.sum(value).over(Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__s", inside).join(_before(ranged, F.sum(value)), "__p").withColumn(name, F.col("__before") + F.col("__s")).drop("__p", "__i", "__s", "__before")


def union_first(frames: Sequence[DataFrame], key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """All rows of all frames, then the first of each key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return top_per_key(out, key, order).drop("rank_in_group")


def set_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b, both): sizes of the differences and the intersection of two key columns."""
    sides = a.select(F.col(a.columns[0]).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(b.columns[0]).alias("k"), F.lit(0), F.lit(1)))
    keys = sides.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = lambda test: F.count(F.when(test, 1))
    return keys.agg(n((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), n((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), n((F.col("a") == 1) & (F.col("b") == 1)).alias("both"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same bag of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def mismatches(df: DataFrame, reference: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column_name) of cells that differ from the reference; a null equals a null only."""
    other = reference.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]))
    return df.join(other, list(keys)).select(*keys, F.explode(differs).alias("column_name"))


def beside(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Each row with the columns of a one-row frame, as scalar subqueries: no join, and an error if there were more rows."""
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})
