"""Intervals, agreement, detector metrics, weighted and distribution statistics over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.relational import beside, running_sum

Z95 = 1.959964


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of a share; null where n is 0."""
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2), n)) / d
    margin = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / d
    return centre - margin, centre + margin


def flag_summary(df: DataFrame, flags: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, flag, n, positive, rate, low, high): flags are summed side by side in one pass, then turned long."""
    sums = df.groupBy(*group).agg(F.count("*").alias("n"), *[F.count(F.when(F.col(f), 1)).alias(f) for f in flags])
    long = sums.unpivot([*group, "n"], list(flags), "flag", "positive")
    low, high = wilson(F.col("positive"), F.col("n"))
    return long.select(*group, "flag", "n", "positive", F.try_divide(F.col("positive").cast("double"), F.col("n").cast("double")).alias("rate"), low.alias("low"), high.alias("high"))


def weighted_rate(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value.cast("double") * weight), F.sum(weight))


def prevalence_views(df: DataFrame, flag: str, exact: str, family: str, order: str) -> DataFrame:
    """A flag's rate in four views: all rows, the first of each exact text, the first of each family, and families of equal weight."""
    rows = df.select(F.col(flag).cast("double").alias("x"), F.col(exact).alias("e"), F.col(family).alias("f"), F.col(order).alias("o"))
    first = F.min_by("x", "o")
    families = rows.groupBy("f").agg(first.alias("m"), F.avg("x").alias("a"))
    parts = [("raw", rows, "x"), ("exact_dedup", rows.groupBy("e").agg(first.alias("m")), "m"), ("family_representative", families, "m"), ("family_equal_weight", families, "a")]
    out = None
    for view, frame, column in parts:
        one = frame.agg(F.lit(view).alias("view"), F.avg(column).alias("rate"))
        out = one if out is None else out.union(one)
    return out


def weighted_quantiles(df: DataFrame, value: str, weight: str, quantiles: Sequence[float]) -> DataFrame:
    """(q, value): midpoints of cumulative weights, linear between them, clamped at the ends. Equal values are summed first."""
    points = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("x"), F.col(weight).alias("w1")).agg(F.count("*").alias("c"))
    points = points.withColumn("w", F.col("w1") * F.col("c"))
    run = running_sum(points, ["x", "w1"], "w", "cum")
    total = points.agg(F.sum("w").alias("total"))  # one row
    # rows of one value lie next to each other: the midpoints of the first and the last bracket the others
    middles = F.array(F.col("cum") - F.col("w") + F.col("w1") / 2, F.col("cum") - F.col("w1") / 2)
    ends = beside(run, total).select("x", F.explode(middles).alias("m"), "total").select("x", (F.col("m") / F.col("total")).alias("p"))
    parts = []
    for k, q in enumerate(quantiles):
        parts += [F.max(F.when(F.col("p") <= q, F.struct("p", "x"))).alias(f"lo{k}"), F.min(F.when(F.col("p") > q, F.struct("p", "x"))).alias(f"hi{k}")]
    found = ends.agg(*parts)
    rows = []
    for k, q in enumerate(quantiles):
        lo, hi = F.col(f"lo{k}"), F.col(f"hi{k}")
        between = lo["x"] + (hi["x"] - lo["x"]) * (q - lo["p"]) / (hi["p"] - lo["p"])
        rows.append(F.struct(F.lit(q).alias("q"), F.coalesce(between, lo["x"], hi["x"]).alias("value")))
    return found.select(F.inline(F.array(*rows)))


def precision_recall(df: DataFrame, gold: Column, found: Column, group: Sequence[str] = ()) -> DataFrame:
    n = lambda test: F.count(F.when(test, 1))
    sums = df.groupBy(*group).agg(n(gold & found).alias("tp"), n(~gold & found).alias("fp"), n(gold & ~found).alias("fn"), n(~gold & ~found).alias("tn"))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return sums.withColumns({"precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn)})


def kappa(df: DataFrame, a: str, b: str, allowed: Sequence[str]) -> DataFrame:
    """(n, agreement, kappa) over rows where both labels are allowed; kappa is null if chance alone agrees."""
    rows = df.filter(F.col(a).isin(*allowed) & F.col(b).isin(*allowed))
    counts = rows.groupBy(a, b).count()
    sums = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("count"))), F.lit(0)).alias("same"),
        *[F.coalesce(F.sum(F.when(F.col(c) == v, F.col("count"))), F.lit(0)).alias(f"{s}{k}") for s, c in (("a", a), ("b", b)) for k, v in enumerate(allowed)],
    )
    n = F.col("n").cast("double")
    po = F.try_divide(F.col("same"), n)
    pe = sum((F.try_divide(F.col(f"a{k}") * F.col(f"b{k}"), n * n) for k in range(len(allowed))), F.lit(0.0))
    return sums.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def binary_agreement(df: DataFrame, a: Column, b: Column, group: Sequence[str] = ()) -> DataFrame:
    """Positive and negative agreement and PABAK."""
    n = lambda test: F.count(F.when(test, 1)).cast("double")
    sums = df.groupBy(*group).agg(n(a & b).alias("both"), n(a & ~b).alias("only_a"), n(~a & b).alias("only_b"), n(~a & ~b).alias("neither"))
    both, oa, ob, no = (F.col(c) for c in ("both", "only_a", "only_b", "neither"))
    return sums.select(
        *group, F.try_divide(2 * both, 2 * both + oa + ob).alias("positive_agreement"), F.try_divide(2 * no, 2 * no + oa + ob).alias("negative_agreement"), (2 * F.try_divide(both + no, both + oa + ob + no) - 1).alias("pabak")
    )


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two arrays; two empty ones agree."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def label_set_metrics(df: DataFrame, gold: str, found: str) -> DataFrame:
    """Micro precision, recall and F1 over label sets, and the share of rows whose sets are equal."""
    both, g, f = F.size(F.array_intersect(gold, found)), F.size(F.array_distinct(gold)), F.size(F.array_distinct(found))
    sums = df.agg(F.sum(both).alias("tp"), F.sum(f - both).alias("fp"), F.sum(g - both).alias("fn"), F.avg(((both == g) & (both == f)).cast("double")).alias("exact_set_accuracy"))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return sums.withColumns({"precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn)})


def decision_metrics(df: DataFrame, gold: Column, found: Column, reject: str = "rejected", group: Sequence[str] = ()) -> DataFrame:
    """Accuracy of decisions, and precision, recall and F1 of the one that rejects."""
    n = lambda test: F.count(F.when(test, 1))
    is_gold, is_found = F.coalesce(gold == reject, F.lit(False)), F.coalesce(found == reject, F.lit(False))
    sums = df.groupBy(*group).agg(F.count("*").alias("n"), n(gold.eqNullSafe(found)).alias("same"), n(is_gold & is_found).alias("tp"), n(~is_gold & is_found).alias("fp"), n(is_gold & ~is_found).alias("fn"))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return sums.select(*group, "n", d(F.col("same"), F.col("n")).alias("accuracy"), d(tp, tp + fp).alias("reject_precision"), d(tp, tp + fn).alias("reject_recall"), d(2 * tp, 2 * tp + fp + fn).alias("reject_f1"))


def compared_judges(df: DataFrame, gold: str, views: dict[str, str], decision: str, reject: str = "rejected") -> DataFrame:
    """(view, metrics): label sets and decisions of each view of the same rows, such as a judge alone and combined with rules. views: name to the column with its labels; a view with labels rejects. decision: the gold decision's column."""
    out = None
    for name, column in views.items():
        rows = df.withColumn("__found", F.when(F.size(column) > 0, reject).otherwise("kept"))
        sets = label_set_metrics(rows, gold, column).select("tp", "fp", "fn", "exact_set_accuracy", "precision", "recall", "f1")
        one = beside(sets, decision_metrics(rows, F.col(decision), F.col("__found"), reject).select("accuracy", "reject_precision", "reject_recall", "reject_f1"))
        one = one.select(F.lit(name).alias("view"), *one.columns)
        out = one if out is None else out.union(one)
    return out


def jensen_shannon(p: Sequence[Column], q: Sequence[Column], floor: float = 1e-12) -> Column:
    """Divergence of two histograms in bits, each bin raised by the floor first."""
    p, q = [c.cast("double") + floor for c in p], [c.cast("double") + floor for c in q]
    total = lambda x: sum(x[1:], x[0])
    p, q = [c / total(p) for c in p], [c / total(q) for c in q]
    half = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: total([a * F.log2(a / m) for a, m in zip(x, half, strict=True)])
    return (kl(p) + kl(q)) / 2


def rate_gate(observed: Column, wanted: Column, n: Column) -> Column:
    """Whether a rate is within max(0.10, 2.5 standard errors)."""
    return F.abs(observed - wanted) <= F.greatest(F.lit(0.10), 2.5 * F.sqrt(wanted * (1 - wanted) / n))


def describe(df: DataFrame, value: str, group: Sequence[str] = (), quantiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (F.stddev_samp(value) / F.avg(value)).alias("cv"), F.min(value).alias("min"), F.max(value).alias("max"), *[F.percentile(value, F.lit(q)).alias(f"p{round(100 * q):02d}") for q in quantiles]
    )


def split_table(df: DataFrame, category: str, split: str, splits: Sequence[str]) -> DataFrame:
    """Counts and shares by split, their ratio and gap, for the first two splits."""
    counts = df.groupBy(category).agg(*[F.count(F.when(F.col(split) == s, 1)).alias(f"n_{s}") for s in splits])
    totals = df.agg(*[F.count(F.when(F.col(split) == s, 1)).alias(f"t_{s}") for s in splits])
    out = beside(counts, totals)
    for s in splits:
        out = out.withColumn(f"share_{s}", F.try_divide(F.col(f"n_{s}").cast("double"), F.col(f"t_{s}").cast("double")))
    a, b = (F.col(f"share_{s}") for s in splits[:2])
    return out.withColumns({"ratio": F.try_divide(a, b), "gap": F.abs(a - b)}).drop(*[f"t_{s}" for s in splits])


def membership_hash(ids: str) -> Column:
    """One digest for a set of ids, independent of their order; sorted per group, for groups that fit in a task."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(ids).cast("string"))), "\n"), 256)


def conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose rows differ, and in which columns; a null differs from a value."""
    differs = lambda c: F.countDistinct(c) + F.max(F.col(c).isNull().cast("int")) > 1
    found = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in columns])).alias("columns"))
    return found.filter(F.size("columns") > 0).select(key, "n_rows", F.array_join("columns", "|").alias("conflict_columns"))


def joined_set(column: str) -> Column:
    """Distinct values of a group, sorted, joined by bars."""
    return F.concat_ws("|", F.array_sort(F.collect_set(column)))


def mode_value(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the smaller value."""
    counts = df.groupBy(*group, value).count()
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("count")).alias("c"), F.col(value).alias("v"))).alias("m")).select(*group, F.col("m.v").alias("mode"), (-F.col("m.c")).alias("mode_count"))
