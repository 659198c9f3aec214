"""Queries over turns and generated dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import dialogue as D
from corpusloom.plans.catalog import query, table


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("turn_context", "SELECT conv_id, turn, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role, CAST(length(lag(text) OVER w) AS BIGINT) AS previous_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_context(spark, sf_dir):
    """WN5, CF21."""
    found = D.turn_context(turns(spark, sf_dir), "conv_id", "turn", ["role", "text"])
    return found.select("conv_id", "turn", "previous_role", "next_role", F.length("previous_text").cast("bigint").alias("previous_chars"))


@query("question_pairs", "SELECT conv_id, turn, coalesce(nr = 'user', false) AS user_follows, CAST(length(na) AS BIGINT) AS answer_chars FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS na FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND contains(text, ',')")
def question_pairs(spark, sf_dir):
    """JN12: a turn of one role and the turn that follows; a comma stands for the question mark that the turns lack."""
    found = D.question_pairs(turns(spark, sf_dir), "conv_id", "turn", "role", "text", question=",")
    return found.select("conv_id", "turn", "user_follows", F.length("answer").cast("bigint").alias("answer_chars"))


SQL_DIALOGUES = """d AS (SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system, CAST(sum(length(text)) AS BIGINT) AS n_chars, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
bool_and(CASE WHEN b IS NULL THEN role = 'user' ELSE role <> b AND role IN ('user', 'assistant') END) AS alternates, string_agg(role, ' > ' ORDER BY turn) AS role_sequence FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) GROUP BY conv_id)"""


@query("dialogue_summary", f"WITH {SQL_DIALOGUES} SELECT * FROM d")
def dialogue_summary(spark, sf_dir):
    """FE19, WN12, AG1."""
    return D.dialogue_summary(turns(spark, sf_dir), "conv_id", "turn", "role", "text")


@query("dialogue_structure", f"WITH {SQL_DIALOGUES} SELECT first_role, count(*) AS n, round(avg(alternates::INTEGER), 9) AS alternating, round(avg((n_turns IN (4, 6, 8))::INTEGER), 9) AS valid_length, count(DISTINCT role_sequence) AS sequences FROM d GROUP BY first_role")
def dialogue_structure(spark, sf_dir):
    """CF22, CF23, AG31: structure rates of dialogues."""
    found = dialogue_summary(spark, sf_dir)
    rate = lambda c, n: F.round(F.avg(c.cast("int")), 9).alias(n)
    return found.groupBy("first_role").agg(F.count("*").alias("n"), rate(F.col("alternates"), "alternating"), rate(F.col("n_turns").isin(4, 6, 8), "valid_length"), F.countDistinct("role_sequence").alias("sequences"))


SQL_FEATURES = """a AS (SELECT conv_id, turn, role, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words, CASE WHEN contains(text, ',') THEN 'list' WHEN length(text) > 60 THEN 'tell' WHEN role = 'user' THEN 'ask' END AS action FROM conversations),
n AS (SELECT *, first_value(action IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM a),
f AS (SELECT conv_id, arg_min(role, turn) AS flow, arg_max(role, turn) AS subflow, CAST(sum(words) AS BIGINT) AS n_words, coalesce(string_agg(action, ' > ' ORDER BY turn), '') AS action_sequence, coalesce(string_agg(action || '->' || later, ' > ' ORDER BY turn), '') AS next_steps, count(DISTINCT action) AS n_actions, coalesce(sum(chars) FILTER (role = 'assistant'), 0) / sum(chars) AS share FROM n GROUP BY conv_id)"""


def acting(spark, sf_dir):
    """Turns' actions by simple signs: a comma lists, length tells, a short user turn asks."""
    rows = turns(spark, sf_dir)
    action = F.when(F.contains("text", F.lit(",")), "list").when(F.length("text") > 60, "tell").when(F.col("role") == "user", "ask")
    flows = rows.groupBy("conv_id").agg(F.min_by("role", "turn").alias("flow"), F.max_by("role", "turn").alias("subflow"))
    return D.dialogue_features(rows, "conv_id", "turn", "role", "text", action).join(flows, "conv_id")


@query("dialogue_features", f"WITH {SQL_FEATURES} SELECT conv_id, n_words, CASE WHEN n_words <= 50 THEN '<=50' WHEN n_words <= 100 THEN '51-100' WHEN n_words <= 150 THEN '101-150' WHEN n_words <= 250 THEN '151-250' WHEN n_words <= 500 THEN '251-500' WHEN n_words <= 1000 THEN '501-1000' ELSE '>1000' END AS length_bucket, action_sequence, next_steps, n_actions, round(share, 9) AS assistant_share FROM f")
def dialogue_features(spark, sf_dir):
    """FE19: length buckets, action and next-step sequences, and the assistant's share."""
    return acting(spark, sf_dir).select("conv_id", "n_words", "length_bucket", "action_sequence", "next_steps", "n_actions", F.round(F.coalesce("assistant_share", F.lit(0.0)), 9).alias("assistant_share"))


@query("flow_summary", f"WITH {SQL_FEATURES} SELECT flow, subflow, count(*) AS n, count(DISTINCT action_sequence) AS sequences, round(avg(n_words), 6) AS mean_words FROM f GROUP BY ALL")
def flow_summary(spark, sf_dir):
    """CF22: dialogues and different action sequences by flow and subflow, here the first and the last role."""
    found = D.flow_summary(acting(spark, sf_dir), "flow", "subflow", "action_sequence", "n_words")
    return found.select("flow", "subflow", "n", "sequences", F.round("mean_words", 6).alias("mean_words"))


@query("stage_summary", "SELECT role, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) AS n, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.75), 6) AS p75 FROM (SELECT role, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split, length(text) AS n FROM conversations) GROUP BY GROUPING SETS ((role), (role, split))")
def stage_summary(spark, sf_dir):
    """AG27: statistics per stage over all rows and per split, by grouping sets."""
    rows = turns(spark, sf_dir).select("role", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("split"), F.length("text").alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    sums = rows.groupingSets([[F.col("role")], [F.col("role"), F.col("split")]], "role", "split").agg(F.grouping("split").alias("g"), F.count("*").alias("n_rows"), F.avg("n").alias("mean"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"))
    return sums.select("role", F.when(F.col("g") == 1, "all").otherwise(F.col("split")).alias("split"), F.col("n_rows").alias("n"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "p25", "p75")])


@query("stage_deltas", "WITH s AS (SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations GROUP BY ALL) SELECT a.conv_id, a.role AS stage_a, b.role AS stage_b, b.n - a.n AS delta FROM s a JOIN s b ON a.conv_id = b.conv_id AND (a.role, b.role) IN (('user', 'assistant'), ('system', 'user'))")
def stage_deltas(spark, sf_dir):
    """JN13: differences between stages of a case."""
    sums = turns(spark, sf_dir).groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("n"))
    stages = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "system", "user")
    left = sums.select("conv_id", F.col("role").alias("stage_a"), F.col("n").alias("na"), stages.alias("stage_b")).filter("stage_b is not null")
    return left.join(sums.select("conv_id", F.col("role").alias("stage_b"), "n"), ["conv_id", "stage_b"]).select("conv_id", "stage_a", "stage_b", (F.col("n") - F.col("na")).alias("delta"))


EXCERPT = "The card was charged twice in one week and the shop would not return the second payment"
GENERATED = [
    ("s1", 4, [("user", "My card was used"), ("assistant", "Please tell me more"), ("user", "It was twice"), ("assistant", "Thank you")], True, None, None),
    ("s2", 4, [("user", "Hi"), ("assistant", "Please confirm your password"), ("user", "No"), ("assistant", "We will refund it")], True, None, None),
    ("s3", 6, [("user", "Hi"), ("assistant", "Hello"), ("user", "mail a@b.example"), ("assistant", "ok")], True, None, None),
    ("s4", 4, [("assistant", "Hi"), ("user", "Hello"), ("assistant", "So"), ("user", "ok")], True, None, None),
    ("s5", 4, [("user", "Well"), ("assistant", "the shop would not return the second payment"), ("user", "x"), ("assistant", "y")], True, "review", ["unsupported_product_policy"]),
    ("s6", 4, [("user", "Well"), ("assistant", "fine"), ("user", "x"), ("assistant", "y")], True, "accept", []),
    ("s7", 4, [("user", "Well"), ("assistant", "fine"), ("user", "x"), ("assistant", "y")], True, "reject", []),
    ("s8", 4, [("user", "Well"), ("assistant", "fine"), ("user", "x"), ("assistant", "y")], False, None, None),
]
EXPECTED_ROUTES = """('s1', '', 'review'), ('s2', 'assistant_outcome_or_deadline_promise|assistant_sensitive_credential_request|assistant_unavailable_action_claim', 'rejected'), ('s3', 'conversation_length_mismatch|regex_pii:email', 'rejected'), ('s4', 'conversation_length_mismatch|conversation_schema_invalid', 'rejected'),
('s5', 'source_8gram_copied|unsupported_product_policy', 'review'), ('s6', '', 'validated'), ('s7', '', 'rejected'), ('s8', 'unknown_or_missing_seed_id', 'rejected')"""


@query("generated_routes", f"SELECT * FROM (VALUES {EXPECTED_ROUTES}) AS t(seed_id, reasons, route)")
def generated_routes(spark, sf_dir):
    """GV10, GV11, SK7, CF25: reasons against generated dialogues, and their routes."""
    schema = "seed_id string, expected int, conversation array<struct<role: string, content: string>>, known boolean, decision string, extra array<string>"
    rows = spark.createDataFrame(GENERATED, schema)
    found = D.dialogue_reasons(F.col("seed_id"), F.col("conversation"), F.col("expected"), F.lit("A summary."), F.array().cast("array<string>"), F.lit(EXCERPT), F.col("extra"))
    found = rows.withColumn("r", F.when(F.col("known"), found).otherwise(F.array(F.lit("unknown_or_missing_seed_id"))))
    return found.select("seed_id", F.array_join("r", "|").alias("reasons"), D.route(F.col("r"), F.col("decision").isNotNull(), F.col("decision"), F.col("known")).alias("route"))


@query("conversation_routes", """WITH t AS (SELECT conv_id, count(*) AS n, bool_and(CASE WHEN turn % 2 = 0 THEN role = 'user' ELSE role = 'assistant' END) AS a, string_agg(text, chr(10) ORDER BY turn) AS g FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, list_sort(list_filter([CASE WHEN NOT (a AND n IN (4, 6, 8)) THEN 'conversation_schema_invalid' END, CASE WHEN NOT (a AND n IN (4, 6, 8)) OR n <> 4 THEN 'conversation_length_mismatch' END, CASE WHEN a AND n IN (4, 6, 8) AND regexp_matches(g, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b') THEN 'regex_pii:email' END], lambda x: x IS NOT NULL)) AS reasons FROM t) SELECT list_aggregate(reasons, 'string_agg', '|') AS reasons, CASE WHEN len(reasons) > 0 THEN 'rejected' ELSE 'review' END AS route, count(*) AS n FROM r GROUP BY ALL""")
def conversation_routes(spark, sf_dir):
    """GV10, GV11 over all conversations, with the structure and mail rules."""
    msgs = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("conversation"))
    c = F.col("conversation")
    order = F.forall(F.transform(c, lambda m, i: m["role"] == F.when(m["turn"] % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    sound = order & F.size(c).isin(*D.VALID_LENGTHS)
    text = F.array_join(F.transform(c, lambda m: m["content"]), "\n")
    when = lambda t, r: F.when(t, F.lit(r))
    reasons = F.array_sort(F.array_compact(F.array(when(~sound, "conversation_schema_invalid"), when(~sound | (F.size(c) != 4), "conversation_length_mismatch"), when(sound & text.rlike(X.RELEASE_PII[0][1]), "regex_pii:email"))))
    rows = msgs.select(reasons.alias("r")).select(F.when(F.size("r") > 0, F.array_join("r", "|")).alias("reasons"), D.route(F.col("r"), F.lit(False), F.lit(None).cast("string"), F.lit(True)).alias("route"))
    return rows.groupBy("reasons", "route").agg(F.count("*").alias("n"))


@query("speaker_turns", "SELECT * FROM (VALUES (1, 0, 'Amanda', 'I baked cookies. Do you want some?'), (1, 1, 'Jerry', 'Sure!'), (2, 0, '', 'no name here')) AS t(id, turn, speaker, words)")
def speaker_turns(spark, sf_dir):
    """TX23: turns out of lines with names; lines without one go on."""
    rows = spark.createDataFrame([(1, "Amanda: I baked cookies.\nDo you want some?\r\nJerry: Sure!"), (2, "no name here")], "id int, text string")
    found = D.speaker_turns(rows, "id", "text")
    least = found.groupBy("id").agg(F.min("turn").alias("t0"))
    return found.join(least, "id").select("id", (F.col("turn") - F.col("t0")).cast("int").alias("turn"), "speaker", "words")


@query("evidence_units", """WITH u AS (SELECT item_id, list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]+|$)')], lambda x: x <> '') AS s FROM benchmark) SELECT item_id, format('G{:03d}', k) AS unit_id, s[k] AS unit_text FROM (SELECT item_id, s, unnest(range(1, len(s) + 1)) AS k FROM u) UNION ALL SELECT item_id, 'L001', 'item: ' || item_id FROM benchmark UNION ALL SELECT item_id, 'L002', 'kind: benchmark' FROM benchmark UNION ALL SELECT item_id, 'S001', 'item ' || item_id FROM benchmark UNION ALL SELECT item_id, 'S002', substr(text, 1, 20) FROM benchmark""")
def evidence_units(spark, sf_dir):
    """GV16: labels, numbered sentences and generated strings of benchmark items."""
    items = table(spark, sf_dir, "benchmark")
    key = F.col("item_id").cast("string")
    made = F.struct(F.concat(F.lit("item "), key).alias("summary"), F.array(F.substring("text", 1, 20)).alias("notes"))
    return D.all_units(items.withColumn("generated", made), "item_id", "text", {"item": key, "kind": F.lit("benchmark")}, [F.col("generated.summary")], F.col("generated.notes"))


@query("evidence_checks", "SELECT item_id, contains(text, substr(text, 5, 20)) AS valid, false AS empty_valid FROM benchmark")
def evidence_checks(spark, sf_dir):
    """GV17: quotations must stand in their source."""
    return table(spark, sf_dir, "benchmark").select("item_id", D.evidence_valid(F.substring("text", 5, 20), F.col("text")).alias("valid"), D.evidence_valid(F.lit(""), F.col("text")).alias("empty_valid"))


@query("compact_seeds", "SELECT conv_id, first.role AS first_role, CAST(n AS BIGINT) AS n, first.excerpt AS excerpt FROM (SELECT conv_id, count(*) AS n, arg_min({'role': role, 'excerpt': substr(text, 1, 60)}, turn) AS first FROM conversations GROUP BY conv_id)")
def compact_seeds(spark, sf_dir):
    """CF18, PF12: fields out of nested records, and an excerpt."""
    nested = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return nested.select("conv_id", F.get("m", 0)["role"].alias("first_role"), F.size("m").cast("bigint").alias("n"), F.substring(F.get("m", 0)["text"], 1, 60).alias("excerpt"))


@query("judge_scores", "SELECT conv_id % 3 AS score, count(DISTINCT conv_id) AS n FROM conversations GROUP BY ALL")
def judge_scores(spark, sf_dir):
    """CF24, GV18's output contract: scores parsed from JSON texts, and their distribution."""
    answers = turns(spark, sf_dir).select("conv_id").distinct().select(F.to_json(F.struct((F.col("conv_id") % 3).alias("score"), F.lit("ok").alias("note"))).alias("raw"))
    return answers.select(F.from_json("raw", "score bigint, note string")["score"].alias("score")).groupBy("score").agg(F.count("*").alias("n"))
