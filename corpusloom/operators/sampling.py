"""Sampling with exact, reproducible accounting: allocations, hash-ordered draws, caps, supplements and quotas.

Order within a stratum is that of a seeded hash of the row's id, so draws repeat on any cluster. Global ranks are taken over the
table of strata alone, never over rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import key_json
from corpusloom.operators.relational import beside

MISSING = "<NA>"


def named_strata(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in strata})


def allocate(df: DataFrame, n: int, strata: Sequence[str]) -> DataFrame:
    """Largest-remainder shares of n rows by stratum; ties go to the smaller JSON list of the stratum's values."""
    if n < 0 or not strata:
        raise ValueError("a size of at least 0 and a stratum are needed")
    counts = named_strata(df, strata).groupBy(*strata).agg(F.count("*").alias("available"))
    total = F.sum("available").over(Window.partitionBy())
    ideal = counts.withColumn("ideal", F.col("available") / total * F.least(F.lit(n).cast("bigint"), total)).withColumn("target", F.least(F.lit(n).cast("bigint"), total))
    floors = ideal.withColumn("floor", F.floor("ideal")).withColumn("fractional_remainder", F.col("ideal") - F.col("floor"))
    left = F.col("target") - F.sum("floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("fractional_remainder"), F.to_json(F.array(*strata))))
    out = floors.withColumn("allocated", F.col("floor") + (place <= left).cast("bigint"))
    share = F.col("allocated") / F.col("available")
    return out.select(*strata, "available", "ideal", "allocated", "fractional_remainder", share.alias("inclusion_probability"), F.try_divide(F.lit(1.0), share).alias("design_weight"))


def stratified_sample(df: DataFrame, n: int, strata: Sequence[str], key: str, seed: int, namespace: str) -> DataFrame:
    """The allocated number of rows of each stratum, first in hash order, with their inclusion probability and weight."""
    shares = allocate(df, n, strata).select(*[F.col(c).alias(f"__{c}") for c in strata], "allocated", "inclusion_probability", "design_weight")
    rows = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in strata})
    names = [f"__{c}" for c in strata]
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*names).orderBy(key_json(seed, namespace, F.col(key)), key)))
    ranked = ranked.filter(F.col("__rank") <= n)
    return ranked.join(shares, names).filter(F.col("__rank") <= F.col("allocated")).select(*df.columns, "inclusion_probability", "design_weight")


def cap_groups(df: DataFrame, group: str, cap: int, order: Sequence[Column | str]) -> DataFrame:
    """The first rows of each group in order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= cap).drop("__rank")


def cap_accounting(df: DataFrame, group: str, cap: int) -> DataFrame:
    """(before, after, removed, groups, groups_over_cap) from group counts alone."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    kept = F.least("n", F.lit(cap))
    return sizes.agg(F.sum("n").alias("before"), F.sum(kept).alias("after"), F.sum(F.col("n") - kept).alias("removed"), F.count("*").alias("groups"), F.count(F.when(F.col("n") > cap, 1)).alias("groups_over_cap"))


def coverage_supplement(df: DataFrame, core: DataFrame, strata: Sequence[str], key: str, seed: int, namespace: str, most: int | None = None) -> DataFrame:
    """The first row, in hash order, of each stratum that the core lacks. Raises if there are more than allowed."""
    rows, covered = named_strata(df, strata), named_strata(core, strata).select(*strata).distinct()
    open_rows = rows.join(covered, list(strata), "left_anti")
    first = F.row_number().over(Window.partitionBy(*strata).orderBy(key_json(seed, namespace, F.col(key)), key))
    out = open_rows.withColumn("__rank", first).filter(F.col("__rank") == 1).drop("__rank").select(*df.columns).withColumn("prevalence_eligible", F.lit(False))
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"the supplement has more than {most} rows")
    return out


def hash_sample(df: DataFrame, n: int, key: Column) -> DataFrame:
    """n rows, first in the order of the key."""
    return df.orderBy(key).limit(n)


def per_group(df: DataFrame, group: Sequence[str], n: int, key: Column) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(key))).filter(F.col("__rank") <= n).drop("__rank")


@dataclass(frozen=True)
class Quota:
    reason: str
    test: Column
    n: int


def quota_sets(df: DataFrame, quotas: Sequence[Quota], strata: Sequence[str], key: str, exclude: Sequence[str], seed: int, namespace: str) -> tuple[DataFrame, DataFrame]:
    """Draw by reason in order; what one reason took, by any of the columns of exclude, later ones can't. The steps depend on each other, so this loops over the few reasons.

    Returns the rows with their reason, and (reason, requested, available, selected).
    """
    taken, accounts = None, None
    for q in quotas:
        open_rows = df.filter(F.coalesce(q.test, F.lit(False)))
        if taken is not None:
            for c in exclude:
                open_rows = open_rows.join(taken.select(c).filter(F.col(c).isNotNull()).distinct(), c, "left_anti")
        for c in exclude:
            if c != key:
                open_rows = cap_groups(open_rows, c, 1, [key_json(seed, namespace, F.col(key)), key])
        drawn = stratified_sample(open_rows.select(*df.columns), q.n, strata, key, seed, f"{namespace}:{q.reason}").select(*df.columns, F.lit(q.reason).alias("quota_reason"))
        account = open_rows.agg(F.count("*").alias("available")).select(F.lit(q.reason).alias("reason"), F.lit(q.n).cast("bigint").alias("requested"), "available", F.least(F.lit(q.n).cast("bigint"), F.col("available")).alias("selected"))
        taken = drawn if taken is None else taken.unionByName(drawn)
        accounts = account if accounts is None else accounts.union(account)
    return taken, accounts


def fill_shortfall(df: DataFrame, planned: DataFrame, n: int, key: str, order: Sequence[Column | str]) -> DataFrame:
    """Planned rows and, up to n in all, the best of the others in order."""
    have = planned.count()
    if have >= n:
        return planned
    reserve = df.join(planned.select(key), key, "left_anti").orderBy(*order).limit(n - have)
    return planned.unionByName(reserve, allowMissingColumns=True)


def per_cell_equal(df: DataFrame, cells: Sequence[str], n: int, key: Column) -> DataFrame:
    """About the same number from each cell; what small cells can't give is filled in round-robin order from the others."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*cells).orderBy(key))).filter(F.col("__rank") <= n)
    return ranked.orderBy("__rank", *cells, key).limit(n).drop("__rank")


def capped_pool(df: DataFrame, protected: Column, n: int, key: Column) -> DataFrame:
    """All protected rows and n others in hash order; weight is 1 for the former and others / n for the latter."""
    safe = df.filter(F.coalesce(protected, F.lit(False))).withColumn("pool_weight", F.lit(1.0))
    others = df.filter(~F.coalesce(protected, F.lit(False)))
    total = others.agg(F.count("*").alias("__n"))
    drawn = beside(others.orderBy(key).limit(n), total)
    return safe.unionByName(drawn.withColumn("pool_weight", F.greatest(F.lit(1.0), F.col("__n") / n)).drop("__n"))


def share_allocation(shares: dict[str, float], n: int) -> dict[str, int]:
    """Sizes of a few cells from reference shares, at least one each, corrected one at a time where rounding was off most."""
    total = sum(shares.values())
    out = {k: max(1, round(n * v / total)) for k, v in shares.items()}
    while sum(out.values()) != n:
        up = sum(out.values()) < n
        movable = [k for k in out if up or out[k] > 1]
        if not movable:
            break
        gap = {k: n * shares[k] / total - out[k] for k in movable}
        k = max(sorted(movable), key=gap.get) if up else min(sorted(movable), key=gap.get)
        out[k] += 1 if up else -1
    return out


def double_annotation(df: DataFrame, n: int, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """Rows that two annotators get, in two copies."""
    names = list(strata)
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*names).orderBy(key_json(seed + 1, "double", F.col(key)))))
    drawn = ranked.filter(F.col("__rank") <= n).orderBy("__rank", *names, key).limit(n).drop("__rank")
    return drawn.withColumn("annotator", F.explode(F.array(F.lit("A"), F.lit("B"))))
