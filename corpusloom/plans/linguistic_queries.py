"""Queries over the linguistic frame, labels, scenarios and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import features as V
from corpusloom.functions import linguistic as N
from corpusloom.functions import text as X
from corpusloom.operators import relational as J
from corpusloom.operators.rules import route_hint
from corpusloom.plans.catalog import query, table

NARRATIVES = """(1, 'I am writing because my debit card was charged twice by the store. I did not authorize the second payment. Please refund it.'),
 (2, 'It was not a credit card but a debit card. I noticed it yesterday and called my bank last week.'), (3, 'Could not pay rent. Then the account was frozen'), (4, 'mi cuenta, por favor'), (5, '')"""
SQL_NARRATIVES = f"n AS (SELECT CAST(id AS BIGINT) AS id, text FROM (VALUES {NARRATIVES}) AS t(id, text))"


def narratives(spark):
    return spark.sql(f"SELECT CAST(id AS BIGINT) AS id, text FROM VALUES {NARRATIVES} AS t(id, text)")


@query("linguistic_frame")
def linguistic_frame(spark, sf_dir):
    """FE12: negation, passives, repairs, dates, speech acts, stages, variation and redaction types."""
    return narratives(spark).select("id", *[c.alias(n) for n, c in N.frame(F.col("text")).items()])


@query("linguistic_corpus", "SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[À-ÖØ-öø-ÿ]')) AS accents, count(*) FILTER (regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:but|however|although|before|after|earlier|later)(?:[^\\p{L}\\p{N}_]|$)')) AS linked FROM documents GROUP BY lang")
def linguistic_corpus(spark, sf_dir):
    """FE12's flags counted over all documents by language."""
    docs = table(spark, sf_dir, "documents")
    n = lambda p, name: F.count(F.when(F.col("text").rlike(p), 1)).alias(name)
    return docs.groupBy("lang").agg(F.count("*").alias("n"), n(N.LATIN_ACCENTS, "accents"), n(N.CLAUSE_LINK, "linked"))


@query("claims_and_slots", f"WITH {SQL_NARRATIVES} SELECT id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in N.CLAIMS.items()) + " ELSE 'unknown_ambiguous' END AS claim, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in N.RAILS.items()) + " ELSE 'unknown' END AS rail, concat_ws('|', " + ", ".join(f"CASE WHEN NOT regexp_matches(text, '{p}') THEN '{n}' END" for n, p in N.SLOTS.items()) + ") AS missing FROM n")
def claims_and_slots(spark, sf_dir):
    """FE13: first claim and rail, and the slots that are missing."""
    t = F.col("text")
    return narratives(spark).select("id", V.first_name(t, N.CLAIMS, "unknown_ambiguous").alias("claim"), V.first_name(t, N.RAILS, "unknown").alias("rail"), F.array_join(V.missing_names(t, N.SLOTS), "|").alias("missing"))


def _has(p):
    quoted = p.replace("'", "''")
    return f"regexp_matches(text, '{quoted}')"


def _listed(tests):
    """Names of the tests that hold, joined, or none_detected."""
    return "coalesce(nullif(concat_ws('|', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items()) + "), ''), 'none_detected')"


_first = lambda patterns, default: "CASE " + " ".join(f"WHEN {_has(p)} THEN '{n}'" for n, p in patterns.items()) + f" ELSE '{default}' END"


@query("scenario_fields", f"WITH {SQL_NARRATIVES}, c AS (SELECT id, text, {_first(N.CLAIMS, 'unknown_ambiguous')} AS claim, {_first(N.RAILS, 'unknown')} AS rail FROM n) SELECT id, claim, rail, CASE WHEN rail IN ('debit_card', 'credit_card', 'prepaid_card') THEN rail ELSE 'unknown' END AS card, coalesce(concat_ws('|', " + ", ".join(f"CASE WHEN {_has(p)} THEN '{s}' END" for s, p in N.SLOTS.items()) + "), '') AS present, " + _listed({s: _has(p) for s, p in N.SPEECH_ACTS.items()}) + " AS speech FROM c")
def scenario_fields(spark, sf_dir):
    """FE15: what the scenario records hold, read back from their JSON."""
    kind = "record_id string, claim_type_candidate string, payment_rail_candidate string, card_type_candidate string, present_slots array<string>, linguistic_features struct<speech_act_layers: string>"
    rows = scenario_records(spark, sf_dir).select("id", F.from_json("record", kind).alias("r"))
    return rows.select("id", F.col("r.claim_type_candidate").alias("claim"), F.col("r.payment_rail_candidate").alias("rail"), F.col("r.card_type_candidate").alias("card"), F.array_join("r.present_slots", "|").alias("present"), F.col("r.linguistic_features.speech_act_layers").alias("speech"))


@query("scenario_records")
def scenario_records(spark, sf_dir):
    """FE15, GV18's input contract: scenario records as JSON."""
    return narratives(spark).select("id", N.scenario_json(F.col("id"), F.col("text"), F.lit("consumer_narrative"), route_hint).alias("record"))


_E = {n: _has(p) for n, p in V.EXTENDED.items() if n != "agentless_passive"}
_SLOTS = {
    "amount": _has(r"\[AMOUNT\]|\$\s*\d"),
    "date": _has(r"\[DATE\]"),
    "account_or_card_type": _has(r"(?i)\b(?:credit card|debit card|prepaid card|Zelle|ACH|wire transfer|checking account|savings account|mortgage|student loan|vehicle loan)\b"),
    "merchant_or_institution": _has(r"(?i)\b(?:merchant|retailer|store|restaurant|vendor|Amazon|Walmart|Uber|Costco|company|collector|lender|bank)\b"),
    "claim_signal": _E["authorization"],
}
_pair = lambda a, b, both, one, other: f"CASE WHEN {a} AND {b} THEN '{both}' WHEN {a} THEN '{one}' WHEN {b} THEN '{other}' ELSE 'none_detected' END"
_N_SLOTS = "(" + " + ".join(f"CAST({t} AS INTEGER)" for t in _SLOTS.values()) + ")"
_TIMES = "len(regexp_extract_all(text, '" + N.TIME_TOKEN + "'))"
SQL_LABELS = f"""SELECT id, {_E['negation']} AS candidate_negation, {_E['hedging']} AS candidate_hedging, {_pair(_E['modality_epistemic'], _E['modality_deontic'], 'epistemic_and_deontic', 'epistemic_only', 'deontic_only')} AS candidate_modality,
{_pair(_E['emotion'], _E['escalation'], 'emotion_and_escalation', 'emotion_only', 'escalation_only')} AS candidate_emotion_escalation,
CASE WHEN {_has(r"(?i)\b(?:can you|could you|would you|will you|I wonder if|I hope you can|why (?:hasn't|haven't|didn't|won't))\b")} THEN 'indirect_request_candidate' WHEN {_has(r"(?i)\b(?:is this a joke|how (?:can|could) (?:you|they)|what kind of|how is this (?:fair|legal|possible))\b")} THEN 'rhetorical_complaint_candidate' WHEN contains(text, '?') THEN 'interrogative_other' ELSE 'none_detected' END AS candidate_speech_act,
{_listed({s: _E['request_or_demand'] if s == 'request' else _has(p) for s, p in N.STAGES.items()})} AS candidate_narrative_stages,
CASE WHEN {_TIMES} = 0 THEN 'no_time_anchor' WHEN {_has(N.NONLINEAR_TIME)} THEN 'nonlinear_or_contrastive' WHEN {_TIMES} = 1 THEN 'single_time_anchor' ELSE 'multiple_time_anchors' END AS candidate_temporal_complexity,
CASE WHEN {_N_SLOTS} >= 4 THEN 'explicit_rich' WHEN {_N_SLOTS} >= 2 THEN 'explicit_partial' WHEN {_N_SLOTS} = 1 THEN 'minimal_explicit' ELSE 'implicit_or_missing' END AS candidate_slot_realization, {_listed(_SLOTS)} AS candidate_explicit_slots FROM n"""


@query("candidate_labels", f"WITH {SQL_NARRATIVES} {SQL_LABELS}")
def candidate_labels(spark, sf_dir):
    """FE16."""
    return narratives(spark).select("id", *[c.alias(n) for n, c in N.candidate_labels(F.col("text")).items()])


@query("entity_strata", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'REGEX:email' WHEN doc_id % 4 = 1 THEN 'US_SSN' WHEN doc_id % 4 = 2 THEN 'PERSON' ELSE 'NONE' END AS primary_type, CASE WHEN doc_id % 4 = 0 THEN 'regex_positive' WHEN doc_id % 4 = 1 THEN 'high_risk_entity' WHEN doc_id % 4 = 2 THEN 'person_location_nrp' ELSE 'no_detection_control' END AS stratum FROM documents")
def entity_strata(spark, sf_dir):
    """FE26."""
    k = F.col("doc_id") % 4
    none = F.array().cast("array<string>")
    patterns = F.when(k == 0, F.array(F.lit("ipv4"), F.lit("email"))).otherwise(none)
    entities = F.when(k == 1, F.array(F.lit("PERSON"), F.lit("US_SSN"))).when(k == 2, F.array(F.lit("DATE"), F.lit("PERSON"))).otherwise(none)
    rows = table(spark, sf_dir, "documents").select("doc_id", patterns.alias("p"), entities.alias("e"))
    return rows.select("doc_id", N.primary_entity(F.col("p"), F.col("e")).alias("primary_type"), N.entity_stratum(F.col("p"), F.col("e")).alias("stratum"))


@query("entity_findings")
def entity_findings(spark, sf_dir):
    """FE25: findings of an analyzer as a table function, over all documents."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[@0-9]")).select("doc_id", "text")
    return docs.lateralJoin(N.findings(N.regex_analyzer)(F.col("text").outer())).drop("text")


@query("event_positions", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n, CAST(coalesce(length(string_split_regex(text, '[0-9]+')[1]), 0) AS BIGINT) AS first_start FROM documents WHERE regexp_matches(text, '[0-9]')")
def event_positions(spark, sf_dir):
    """TX24's native form: where matches stand."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]")).select("doc_id", X.match_positions(F.col("text"), "[0-9]+").alias("m"))
    return docs.select("doc_id", F.size("m").cast("bigint").alias("n"), F.get("m", 0)["start"].cast("bigint").alias("first_start"))


@query("reference_mismatches", "SELECT doc_id, 'lang' AS column_name FROM documents WHERE doc_id % 50 = 3")
def reference_mismatches(spark, sf_dir):
    """SC11: cells that differ from a reference table, nulls and all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changed = docs.withColumn("lang", F.when(F.col("doc_id") % 50 == 3, F.lit(None)).otherwise(F.col("lang")))
    return J.mismatches(docs, changed, ["doc_id"], ["lang", "source"])


@query("label_lines", "SELECT doc_id, 'language: ' || lang || chr(10) || 'source: ' || source AS lines FROM documents")
def label_lines(spark, sf_dir):
    """TX26."""
    return table(spark, sf_dir, "documents").select("doc_id", X.label_lines(language=F.col("lang"), source=F.col("source")).alias("lines"))


@query("case_stages", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS user_text, count(*) FILTER (role = 'assistant') AS assistant_turns FROM conversations GROUP BY conv_id")
def case_stages(spark, sf_dir):
    """CF19: the stages of a case out of its turns."""
    rows = table(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    found = rows.groupBy("conv_id").agg(F.transform(said, lambda m: m["text"]).alias("u"), F.count(F.when(F.col("role") == "assistant", 1)).alias("assistant_turns"))
    return found.select("conv_id", F.when(F.size("u") > 0, F.array_join("u", "\n")).alias("user_text"), "assistant_turns")
