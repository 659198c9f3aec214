"""Queries over reviews, clearances, gates and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import governance as G
from corpusloom.operators import relational as J
from corpusloom.operators import rules as R
from corpusloom.plans.catalog import query, table


MAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
# each check: its name, the rows that break it as SQL over d (documents), l (labels) and b (benchmark), which Spark and DuckDB both read
CHECKS = {
    "no blank text": "SELECT 1 FROM d WHERE trim(text) = ''",
    "no null text": "SELECT 1 FROM d WHERE text IS NULL",
    "no null id": "SELECT 1 FROM d WHERE doc_id IS NULL",
    "unique ids": "SELECT 1 FROM (SELECT row_number() OVER (PARTITION BY doc_id ORDER BY doc_id) AS k FROM d) WHERE k > 1",
    "no negative id": "SELECT 1 FROM d WHERE doc_id < 0",
    "language known": "SELECT 1 FROM d WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de', 'es')",
    "source known": "SELECT 1 FROM d WHERE source IS NULL OR trim(source) = ''",
    "lengths agree": "SELECT 1 FROM d WHERE n_chars <> length(text)",
    "no exact copies": "SELECT 1 FROM (SELECT row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM d) WHERE k > 1",
    "one copy a source": "SELECT 1 FROM (SELECT row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS k FROM d) WHERE k > 1",
    "no mail address": "SELECT 1 FROM d WHERE mail",
    "no redaction mark": "SELECT 1 FROM d WHERE contains(text, '[REDACTED]')",
    "no candidate mark": "SELECT 1 FROM d WHERE contains(text, '[PII_CANDIDATE]')",
    "no control characters": "SELECT 1 FROM d WHERE contains(text, chr(0)) OR contains(text, chr(127))",
    "enough words": "SELECT 1 FROM d WHERE length(text) - length(replace(text, ' ', '')) < 12",
    "texts within the limit": "SELECT 1 FROM d WHERE length(text) > 100000",
    "labels unique": "SELECT 1 FROM (SELECT row_number() OVER (PARTITION BY doc_id ORDER BY doc_id) AS k FROM l) WHERE k > 1",
    "labels known": "SELECT 1 FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)",
    "quality is 0 or 1": "SELECT 1 FROM l WHERE quality IS NULL OR quality NOT IN (0, 1)",
    "toxic is 0 or 1": "SELECT 1 FROM l WHERE toxic IS NULL OR toxic NOT IN (0, 1)",
    "no toxic document": "SELECT 1 FROM l WHERE toxic = 1",
    "no low quality": "SELECT 1 FROM l WHERE quality = 0",
    "every language labelled": "SELECT lang FROM d GROUP BY lang HAVING lang NOT IN (SELECT lang FROM d WHERE doc_id IN (SELECT doc_id FROM l))",
    "labelled share within 0.1": "SELECT 1 FROM (SELECT abs(count(CASE WHEN doc_id IN (SELECT doc_id FROM l) THEN 1 END) / count(*) - 0.4) AS gap FROM d) WHERE gap > 0.1",
    "source cap of a half": "SELECT source FROM d GROUP BY source HAVING count(*) > 0.5 * (SELECT count(*) FROM d)",
    "language floor of a twentieth": "SELECT lang FROM d GROUP BY lang HAVING count(*) < 0.05 * (SELECT count(*) FROM d)",
    "five sources or more": "SELECT 1 FROM (SELECT count(DISTINCT source) AS n FROM d) WHERE n < 5",
    "no benchmark item whole": "SELECT 1 FROM b WHERE text IN (SELECT text FROM d)",
    "items unique": "SELECT 1 FROM (SELECT row_number() OVER (PARTITION BY item_id ORDER BY item_id) AS k FROM b) WHERE k > 1",
    "items not blank": "SELECT 1 FROM b WHERE text IS NULL OR trim(text) = ''",
    "hashes of 64 digits": "SELECT 1 FROM d WHERE length(sha256(text)) <> 64",
    "ids in one range": "SELECT 1 FROM (SELECT max(doc_id) - min(doc_id) + 1 - count(*) AS gap FROM d) WHERE gap <> 0",
    "splits don't overlap": "SELECT 1 FROM d WHERE doc_id IN (SELECT doc_id FROM l WHERE quality = 0) AND doc_id IN (SELECT doc_id FROM l WHERE quality = 1)",
    "no leading byte mark": "SELECT 1 FROM d WHERE starts_with(text, chr(65279))",
}
_DUCK = f"WITH d AS (SELECT *, regexp_matches(text, '{MAIL}') AS mail FROM documents), l AS (SELECT * FROM labels), b AS (SELECT * FROM benchmark) "


@query("release_checks", _DUCK + " UNION ALL ".join(f"""SELECT '{n.replace("'", "''")}' AS "check", count(*) = 0 AS passed, count(*) AS failures FROM ({q})""" for n, q in CHECKS.items()))
def release_checks(spark, sf_dir):
    """GV4, GV5, PF16: a table of checks with their failures: keys, texts, caps, floors, labels, overlaps."""
    frames = {"d": table(spark, sf_dir, "documents").withColumn("mail", F.col("text").rlike(MAIL)), "l": table(spark, sf_dir, "labels"), "b": table(spark, sf_dir, "benchmark")}
    own = lambda q: q.replace("sha256(text)", "sha2(text, 256)").replace("starts_with(", "startswith(").replace("chr(65279)", "decode(unhex('EFBBBF'), 'utf-8')").replace("FROM d", "FROM {d}").replace("FROM l", "FROM {l}").replace("FROM b", "FROM {b}")
    return G.check_table([(n, spark.sql(own(q), **{k: f for k, f in frames.items() if f"{{{k}}}" in own(q)})) for n, q in CHECKS.items()])


@query("clearances", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_reviewed_no_finding' WHEN l.toxic = 1 THEN 'blocked' ELSE 'cleared' END AS clearance_status, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'exclude' ELSE 'allow' END AS release_action FROM documents d LEFT JOIN labels l USING (doc_id)")
def clearances(spark, sf_dir):
    """JN3, GV3, CF14: clearances joined to all rows, with defaults for those not reviewed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    toxic = F.col("toxic") == 1
    given = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "h", F.when(toxic, "blocked").otherwise("cleared").alias("clearance_status"), F.when(toxic, "exclude").otherwise("allow").alias("release_action"))
    return G.clear_rows(docs, given, "doc_id", "h").select("doc_id", "clearance_status", "release_action")


@query("row_overrides", "SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN 'exclude' ELSE 'retain' END AS seed_action, CASE WHEN doc_id % 100 = 7 THEN 'audit|privacy' ELSE '' END AS seed_action_reason FROM documents")
def row_overrides(spark, sf_dir):
    """PF10: reviewed actions by id and text hash replace the rules'."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.lit("retain").alias("seed_action"), F.lit("").alias("seed_action_reason"))
    chosen = docs.filter("doc_id % 100 = 7").select("doc_id", "h", F.lit("exclude").alias("action"), F.explode(F.array(F.lit("privacy"), F.lit("audit"))).alias("reason_code"))
    return R.override_rows(docs, chosen, "doc_id", "h").select("doc_id", "seed_action", "seed_action_reason")


@query("audit_completion", "WITH r AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'uncertain' ELSE 'pending' END AS label, CASE WHEN doc_id % 8 = 2 THEN '' ELSE 'seen' END AS note, doc_id % 2 AS g FROM labels), s AS (SELECT g, count(*) AS rows, count(*) FILTER (label <> 'pending') AS valid, count(*) FILTER (label = 'pending') AS pending, CAST(0 AS BIGINT) AS invalid, count(*) FILTER (label = 'uncertain' AND note = '') AS missing_note FROM r GROUP BY g) SELECT *, CASE WHEN pending > 0 THEN 'pending' WHEN missing_note > 0 THEN 'note_missing' ELSE 'complete' END AS status FROM s")
def audit_completion(spark, sf_dir):
    """AG22, CF16."""
    k = F.col("doc_id")
    label = F.when(k % 4 == 0, "yes").when(k % 4 == 1, "no").when(k % 4 == 2, "uncertain").otherwise("pending")
    rows = table(spark, sf_dir, "labels").select(label.alias("label"), F.when(k % 8 == 2, "").otherwise("seen").alias("note"), (k % 2).alias("g"))
    return G.completion(rows, "label", G.REVIEW_VALUES, "note", ["g"])


@query("audit_metrics", "SELECT CASE WHEN n_chars <= 500 THEN 'short' WHEN n_chars <= 2000 THEN 'middle' ELSE 'long' END AS band, quality, count(*) AS n, round(avg((quality = 1)::INTEGER), 9) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def audit_metrics(spark, sf_dir):
    """AG23: labels and accuracy by band."""
    from corpusloom.functions.features import band

    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy(band(F.col("n_chars"), (500, 2000), ("short", "middle", "long")).alias("band"), "quality").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == 1).cast("int")), 9).alias("accuracy"))


@query("privacy_final", "SELECT CAST(0 AS BIGINT) AS invalid_labels, CAST(0 AS BIGINT) AS invalid_actions, CAST(0 AS BIGINT) AS inconsistent, CAST(0 AS BIGINT) AS unsigned, count(*) FILTER (doc_id % 2 = 0) AS controls, CAST(0 AS BIGINT) AS positive_controls, count(*) FILTER (doc_id % 2 = 0) >= 150 AS cleared FROM labels")
def privacy_final(spark, sf_dir):
    """GV8: the counts behind a privacy release."""
    control = F.col("doc_id") % 2 == 0
    rows = table(spark, sf_dir, "labels").select(F.when(control | (F.col("toxic") == 0), "no").otherwise("yes").alias("manual_pii_present"), F.when(control | (F.col("toxic") == 0), "allow").otherwise("exclude").alias("release_action"), F.lit("r1").alias("reviewer"), F.when(control, "negative_control|x").otherwise("finding").alias("selection_stratum"))
    return G.finalize_privacy(rows, 150)


@query("adjudications", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'yes' WHEN doc_id % 3 = 1 THEN 'no' ELSE 'pending' END AS label, CASE WHEN doc_id % 3 = 0 THEN 'adjudicated' WHEN doc_id % 3 = 1 THEN 'agreed' ELSE 'conflict' END AS adjudication FROM labels")
def adjudications(spark, sf_dir):
    """GV6: two annotators merged into a master that keeps its own rulings."""
    k, labels = F.col("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    master = labels.withColumn("label", F.when(k % 3 == 0, "yes").otherwise("pending"))
    a, b = labels.withColumn("label", F.lit("no")), labels.withColumn("label", F.when(k % 3 == 1, "no").otherwise("yes"))
    return G.merge_adjudication(master, a, b, "doc_id", "label")


@query("review_overlay", "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'relabelled' ELSE lang END AS label FROM documents WHERE doc_id % 10 <> 5")
def review_overlay(spark, sf_dir):
    """GV15."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))
    reviews = docs.filter("doc_id % 10 in (3, 5)").select("doc_id", F.when(F.col("doc_id") % 10 == 5, "bad").otherwise("good").alias("verdict"), F.when(F.col("doc_id") % 10 == 3, "relabelled").alias("new_label"))
    return G.overlay_reviews(docs, reviews, "doc_id")


@query("challenges", """SELECT * FROM (VALUES ('c1', true, true, true), ('c2', true, false, true), ('c3', false, false, true)) AS t(challenge_id, "overlaps", type_matches, passed)""")
def challenges(spark, sf_dir):
    """GV9: overlap is enough, a wrong type is told, a negative passes if nothing is found."""
    rows = spark.createDataFrame([("c1", "mail a@b.example now", "EMAIL", "a@b.example"), ("c2", "ssn 123-45-6789", "SSN", "123-45-6789"), ("c3", "a [REDACTED] text", "", "")], "challenge_id string, text string, expected_entity_type string, expected_value string")
    found = spark.createDataFrame([("c1", "EMAIL", 5, 16), ("c2", "PHONE", 6, 15)], "challenge_id string, entity_type string, start int, end int")
    return G.challenge_results(rows, found, "challenge_id")


@query("inventory_changes", "SELECT * FROM (VALUES ('b', 'changed'), ('c', 'missing'), ('d', 'unexpected')) AS t(path, change)")
def inventory_changes(spark, sf_dir):
    """GV14, GV21."""
    frozen = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    return G.inventory_changes(frozen, spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string"))


@query("label_coverage", "SELECT count(*) FILTER (l.doc_id IS NULL) AS missing, CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS duplicated FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_coverage(spark, sf_dir):
    """GV12, JN11."""
    return G.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("key_reconciliation", "SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def key_reconciliation(spark, sf_dir):
    """JN11, SE3, SK9: keys that one side lacks."""
    return J.key_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("review_summary", "SELECT count(*) AS rows, count(*) FILTER (doc_id % 5 > 0) AS complete, CAST(0 AS BIGINT) AS bad_times, count(*) FILTER (doc_id % 7 = 0 AND NOT (doc_id % 5 > 1)) AS usable_but_failing FROM labels")
def review_summary(spark, sf_dir):
    """GV13, GV20."""
    k = F.col("doc_id")
    value = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "fail").otherwise("pass")
    rows = table(spark, sf_dir, "labels").select(value.alias("a"), F.lit("pass").alias("b"), F.lit("2026-01-02T03:04:05Z").alias("reviewed_utc"), F.when(k % 7 == 0, "usable").otherwise("uncertain").alias("decision"))
    return G.review_summary(rows, ["a", "b"])


@query("pending_oracle", "SELECT conv_id, 'pending' AS review_status, CAST(NULL AS VARCHAR) AS expected_decision FROM conversations GROUP BY conv_id")
def pending_oracle(spark, sf_dir):
    """GV19, CF13: rows for reviewers, never filled by the machine."""
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.lit("pending").alias("review_status"), F.lit(None).cast("string").alias("expected_decision"))


@query("feature_registry", "SELECT * FROM (VALUES ('negation', 'boolean', true), ('uppercase_ratio', 'double', false)) AS t(feature, kind, needs_review)")
def feature_registry(spark, sf_dir):
    """GV22: features and what they are."""
    return spark.createDataFrame([("negation", "boolean", True), ("uppercase_ratio", "double", False)], "feature string, kind string, needs_review boolean")


@query("coverage_cells", "WITH c AS (SELECT lang, source, count(*) AS population FROM documents GROUP BY ALL), k AS (SELECT lang, source, count(*) AS core FROM documents WHERE doc_id % 9 = 0 GROUP BY ALL) SELECT lang, source, population, coalesce(core, 0) AS core FROM c LEFT JOIN k USING (lang, source)")
def coverage_cells(spark, sf_dir):
    """JN8, CF15."""
    docs = table(spark, sf_dir, "documents")
    n = lambda d, c: d.groupBy("lang", "source").agg(F.count("*").alias(c))
    return J.join_filled(n(docs, "population"), n(docs.filter("doc_id % 9 = 0"), "core"), ["lang", "source"], {"core": 0})


@query("prepared_rows", "WITH e AS (SELECT doc_id, lang, substr(text, 1, 200) AS excerpt FROM documents WHERE lang IN ('en', 'de') AND NOT contains(text, '@')), g AS (SELECT * FROM e WHERE len(regexp_extract_all(excerpt, '[A-Za-z]+')) >= 20), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|prepare|' || CAST(doc_id AS VARCHAR))) AS k, sha256('7|prepare|' || CAST(doc_id AS VARCHAR)) AS h FROM g) SELECT doc_id, lang, excerpt FROM r ORDER BY k, lang, h LIMIT 30")
def prepared_rows(spark, sf_dir):
    """CF17: eligible rows with enough grounding, strata in turn."""
    from corpusloom.functions.text import key_joined

    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de") & ~F.contains("text", F.lit("@"))).select("doc_id", "lang", F.substring("text", 1, 200).alias("excerpt"))
    enough = docs.filter(F.size(F.regexp_extract_all("excerpt", F.lit("[A-Za-z]+"), F.lit(0))) >= 20)
    return J.round_robin(enough, ["lang"], key_joined(7, "prepare", F.col("doc_id")), 30).select("doc_id", "lang", "excerpt")
