"""Rule tables as projections: eligibility actions, overrides, labels, coverage of required columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("retain", "exclude", "stress_only")


@dataclass(frozen=True)
class Rule:
    reason: str
    test: Column
    action: str


def apply_rules(df: DataFrame, rules: Sequence[Rule], action: str = "seed_action", reason: str = "seed_action_reason") -> DataFrame:
    """Rules in order; each acts only on rows that are still retained, so a rule whose own action is retain stays open to later ones. A null test counts as false."""
    if wrong := [r.action for r in rules if r.action not in ACTIONS]:
        raise ValueError(f"unknown actions: {wrong}")
    out = df.withColumns({action: F.lit("retain"), reason: F.lit("")})
    for rule in rules:
        hit = (F.col(action) == "retain") & F.coalesce(rule.test, F.lit(False))
        out = out.withColumns({action: F.when(hit, rule.action).otherwise(F.col(action)), reason: F.when(hit, rule.reason).otherwise(F.col(reason))})
    return out


def override_rows(df: DataFrame, overrides: DataFrame, key: str, digest: str, action: str = "seed_action", reason: str = "seed_action_reason") -> DataFrame:
    """Reviewed actions by key and text digest replace the rule's. overrides: key, digest, action, reason_code.

    Raises if one key has two actions, or an override's digest isn't its row's.
    """
    given = overrides.groupBy(key).agg(
        F.countDistinct("action").alias("n_actions"), F.first("action").alias("o_action"), F.concat_ws("|", F.array_sort(F.collect_set("reason_code"))).alias("o_reason"), F.min(digest).alias("o_low"), F.max(digest).alias("o_high")
    )
    if not given.filter("n_actions > 1").isEmpty():
        raise ValueError("an override key has two actions")
    joined = df.join(given, key, "left")
    if not joined.filter((F.col("o_low") != F.col(digest)) | (F.col("o_high") != F.col(digest))).isEmpty():
        raise ValueError("an override was made for another text")
    return joined.select(
        *[c for c in df.columns if c not in (action, reason)], F.coalesce("o_action", action).alias(action), F.coalesce("o_reason", reason).alias(reason)
    )


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"columns are missing: {missing}")
    return df


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """(check, n): blank and repeated keys, in one pass over partial sums."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")) == "", F.lit(True))
    groups = df.groupBy(key).agg(F.count("*").alias("n"), F.first(blank).alias("blank"))
    sums = groups.agg(F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("blank_keys"), F.coalesce(F.sum(F.when(~F.col("blank") & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("repeated_keys"))
    return sums.unpivot([], ["blank_keys", "repeated_keys"], "check", "n")


def release_view(df: DataFrame, renames: dict[str, str], constants: dict[str, object]) -> DataFrame:
    """Columns renamed, constants added, in the declared order."""
    require_columns(df, list(renames))
    return df.select(*[F.col(a).alias(b) for a, b in renames.items()], *[F.lit(v).alias(n) for n, v in constants.items()])


def mark_override(df: DataFrame, changes: dict[str, Column], suffix: str = "_before_override") -> DataFrame:
    """Change columns and keep what they held; a second run is refused."""
    if any(f"{c}{suffix}" in df.columns for c in changes):
        raise ValueError("an override was applied before")
    return df.withColumns({f"{c}{suffix}": F.col(c) for c in changes}).withColumns(changes)


def sampling_frame(population: Column, first: Column, second: Column, recent: Column) -> Column:
    """Which frame a row is drawn from: the population, both enrichments, the first by era, else the second."""
    return (
        F.when(population, "population")
        .when(first & second, "overlap_enrichment")
        .when(first & ~recent, "first_historical_enrichment")
        .when(first, "first_outside_population_enrichment")
        .otherwise("second_historical_enrichment")
    )


def lookup_struct(df: DataFrame, table: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A rule table's other columns as one struct by key; the table is small by its nature and its size is left to the engine to check."""
    rest = [c for c in table.columns if c not in keys]
    return df.join(table.select(*keys, F.struct(*rest).alias(name)), list(keys), "left")


# Reviewing routes by claim and payment rail.
TRANSFER_RAILS = ("debit_card", "prepaid_card", "checking_account", "savings_account", "ach", "zelle", "wire")


def route_hint(claim: Column, rail: Column) -> Column:
    return (
        F.when(claim == "credit_reporting_dispute", "FCRA_credit_reporting_review")
        .when(claim == "debt_validation", "FDCPA_debt_validation_review")
        .when(rail == "credit_card", "Reg_Z_FCBA_credit_card_billing_dispute")
        .when(rail.isin(*TRANSFER_RAILS), "Reg_E_or_transfer_review_requires_facts")
        .when(claim.isin("unauthorized", "identity_theft_fraud", "duplicate", "billing_error"), "unknown_requires_payment_rail_and_card_type")
        .otherwise("nonfinal_triage_requires_human_review")
    )
