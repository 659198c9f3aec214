"""Checks and gates before a release: review records, clearances, reconciliation, frozen inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate that must stay closed."""


def check_table(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(check, passed, failures): each check is a frame of violations and passes if that is empty. One row a check."""
    out = None
    for name, violations in checks:
        row = violations.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), (F.col("failures") == 0).alias("passed"), "failures")
        out = row if out is None else out.union(row)
    return out


def require(checks: DataFrame) -> None:
    failed = [r["check"] for r in checks.filter("not passed").select("check").collect()]  # a row a check
    if failed:
        raise GateError(f"checks failed: {failed}")


def clear_rows(df: DataFrame, clearance: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows with their clearance; rows outside the review are allowed by default. Raises if a clearance is for an unknown key or another text."""
    given = clearance.select(key, F.col(digest).alias("__digest"), "clearance_status", "release_action")
    joined = df.join(given, key, "full_outer")
    unknown = joined.filter(F.col(digest).isNull() & F.col("__digest").isNotNull())
    other = joined.filter(F.col("__digest").isNotNull() & (F.col("__digest") != F.col(digest)))
    require(check_table([("clearance of an unknown key", unknown), ("clearance of another text", other)]))
    return df.join(given.drop("__digest"), key, "left").fillna({"clearance_status": "not_reviewed_no_finding", "release_action": "allow"})


# The values that reviews may hold.
REVIEW_VALUES = ("yes", "no", "uncertain")
RELEASE_ACTIONS = ("allow", "exclude", "redact")


def completion(df: DataFrame, label: str, allowed: Sequence[str], note: str | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Valid, pending, invalid and note-lacking labels, and the status of the audit."""
    bare = F.coalesce(F.trim(F.col(label)), F.lit(""))
    pending = bare.isin("", "pending")
    valid = bare.isin(*allowed)
    missing = valid & (bare == "uncertain") & (F.coalesce(F.trim(F.col(note)), F.lit("")) == "") if note else F.lit(False)
    n = lambda t: F.count(F.when(t, 1))
    sums = df.groupBy(*group).agg(F.count("*").alias("rows"), n(valid).alias("valid"), n(pending).alias("pending"), n(~valid & ~pending).alias("invalid"), n(missing).alias("missing_note"))
    status = F.when(F.col("invalid") > 0, "invalid").when(F.col("pending") > 0, "pending").when(F.col("missing_note") > 0, "note_missing").otherwise("complete")
    return sums.withColumn("status", status)


def finalize_privacy(reviews: DataFrame, least_controls: int = 200, control: str = "negative_control") -> DataFrame:
    """The counts behind a privacy release, with `cleared`: all labels valid, actions fit them, controls suffice and are clean."""
    n = lambda t: F.count(F.when(t, 1))
    label, action = F.col("manual_pii_present"), F.col("release_action")
    is_control = F.col("selection_stratum").startswith(control)
    sums = reviews.agg(
        n(~F.coalesce(label.isin(*REVIEW_VALUES), F.lit(False))).alias("invalid_labels"),
        n(~F.coalesce(action.isin(*RELEASE_ACTIONS), F.lit(False))).alias("invalid_actions"),
        n(F.coalesce(label == "yes", F.lit(False)) & (action == "allow")).alias("inconsistent"),
        n(F.coalesce(F.trim("reviewer"), F.lit("")) == "").alias("unsigned"),
        n(is_control).alias("controls"),
        n(is_control & (label != "no")).alias("positive_controls"),
    )
    clean = (F.col("invalid_labels") + F.col("invalid_actions") + F.col("inconsistent") + F.col("unsigned") + F.col("positive_controls") == 0) & (F.col("controls") >= least_controls)
    return sums.withColumn("cleared", clean)


def merge_adjudication(master: DataFrame, a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """The master's labels, filled by two annotators where they agree; what the master holds stays, and disagreement without a ruling is marked."""
    one = a.select(key, F.col(label).alias("label_a")).join(b.select(key, F.col(label).alias("label_b")), key, "full_outer")
    held = F.when(F.trim(F.col(label)).isin("", "pending"), F.lit(None)).otherwise(F.col(label))
    joined = master.join(one, key, "left")
    agreed = F.when(F.col("label_a") == F.col("label_b"), F.col("label_a"))
    state = F.when(held.isNotNull(), "adjudicated").when(agreed.isNotNull(), "agreed").when(F.col("label_a").isNotNull() & F.col("label_b").isNotNull(), "conflict").otherwise("pending")
    return joined.select(*[c for c in master.columns if c != label], F.coalesce(held, agreed, F.lit("pending")).alias(label), state.alias("adjudication"))


def overlay_reviews(df: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Review verdicts per key: bad or questionable rows go, good ones stay, relabels apply; conflicting relabels raise. reviews: key, verdict, new_label."""
    per = reviews.groupBy(key).agg(F.max(F.col("verdict").isin("bad", "questionable").cast("int")).alias("drop"), F.countDistinct("new_label").alias("n_labels"), F.min("new_label").alias("new_label"))
    if not per.filter("n_labels > 1").isEmpty():
        raise GateError("a row has two new labels")
    return df.join(per.select(key, "drop", "new_label"), key, "left").filter(F.coalesce(F.col("drop"), F.lit(0)) == 0).withColumn("label", F.coalesce("new_label", "label")).drop("drop", "new_label")


def challenge_results(challenges: DataFrame, detections: DataFrame, key: str) -> DataFrame:
    """Per challenge whether a detection overlaps the expected value, whether its type fits, and whether it passes. A challenge without an expected value passes if nothing is found."""
    where = F.instr("text", F.col("expected_value")) - 1
    spans = challenges.withColumns({"s": where, "e": where + F.length("expected_value")})
    found = spans.join(detections, key, "left")
    touch = F.coalesce((F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), F.lit(False))
    per = found.groupBy(key, "expected_value").agg(F.max(touch.cast("int")).alias("o"), F.max((touch & (F.col("entity_type") == F.col("expected_entity_type"))).cast("int")).alias("t"), F.count("start").alias("n"))
    negative = F.coalesce(F.col("expected_value"), F.lit("")) == ""
    return per.select(key, (F.col("o") == 1).alias("overlaps"), F.coalesce(F.col("t") == 1, F.lit(False)).alias("type_matches"), F.when(negative, F.col("n") == 0).otherwise(F.col("o") == 1).alias("passed"))


def inventory_changes(frozen: DataFrame, now: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, change): what is missing, unexpected or changed between two file tables."""
    joined = frozen.select(key, F.col(digest).alias("was")).join(now.select(key, F.col(digest).alias("is")), key, "full_outer")
    change = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unexpected").when(F.col("was") != F.col("is"), "changed")
    return joined.withColumn("change", change).filter("change is not null").select(key, "change")


def coverage(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(missing, unknown, duplicated) keys of what came back."""
    counts = got.groupBy(key).agg(F.count("*").alias("n"))
    joined = expected.select(key).distinct().withColumn("e", F.lit(1)).join(counts, key, "full_outer")
    n = lambda t: F.count(F.when(t, 1))
    return joined.agg(n(F.col("n").isNull()).alias("missing"), n(F.col("e").isNull()).alias("unknown"), n(F.col("n") > 1).alias("duplicated"))


def review_summary(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Rows and their states, in one pass: complete, well-formed times, and rows called usable that fail a dimension."""
    n = lambda t: F.count(F.when(t, 1))
    filled = [F.coalesce(F.col(d).isin("pass", "fail", "uncertain"), F.lit(False)) for d in dimensions]
    every, passed = filled[0], F.coalesce(F.col(dimensions[0]) == "pass", F.lit(False))
    for f, d in zip(filled[1:], dimensions[1:], strict=True):
        every, passed = every & f, passed & F.coalesce(F.col(d) == "pass", F.lit(False))
    utc = F.coalesce(F.col("reviewed_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|\+00:00)$"), F.lit(False))
    return df.agg(F.count("*").alias("rows"), n(every).alias("complete"), n(~utc).alias("bad_times"), n((F.col("decision") == "usable") & ~passed).alias("usable_but_failing"))


def validate_rules(rules: dict[str, dict], required: dict[str, Sequence[str]], enums: dict[str, Sequence[object]] | None = None) -> None:
    """Every area and key of a decision record is there, none is unknown, and enumerated values are allowed; the record is small and lives on the driver."""
    problems = [f"missing area {a}" for a in required if a not in rules] + [f"unknown area {a}" for a in rules if a not in required]
    for area, keys in required.items():
        problems += [f"missing key {area}.{k}" for k in keys if k not in rules.get(area, {})]
    for path, allowed in (enums or {}).items():
        area, key = path.split(".")
        if area in rules and key in rules[area] and rules[area][key] not in allowed:
            problems.append(f"{path} is {rules[area][key]!r}")
    if problems:
        raise GateError("; ".join(problems))


def bound_inputs(files: DataFrame, expected: dict[str, str]) -> None:
    """Every named file is there with the digest that a decision was made for; a table of few files. files: path, sha256."""
    found = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in files.select("path", "sha256").collect()}  # a row a file
    wrong = sorted(n for n, d in expected.items() if found.get(n) != d)
    if wrong:
        raise GateError(f"inputs are missing or changed: {wrong}")


def decision_gate(record: dict, approvals: Sequence[str], coverage: tuple[int, int] | None = None) -> None:
    """A release record on the driver: every approval signed and dated, nothing pending, and as many rows reviewed as there are."""
    problems = []
    for name in approvals:
        entry = record.get(name) or {}
        if entry.get("decision") != "approve":
            problems.append(f"{name} is not approved")
        if not entry.get("reviewer") or not entry.get("reviewed_utc"):
            problems.append(f"{name} is not signed and dated")
    if coverage is not None and coverage[0] != coverage[1]:
        problems.append(f"{coverage[0]} of {coverage[1]} rows are reviewed")
    if problems:
        raise GateError("; ".join(problems))
