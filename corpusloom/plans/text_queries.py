"""Queries over text views and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import features as V
from corpusloom.functions import text as X
from corpusloom.operators import dialogue as D
from corpusloom.operators import rules as R
from corpusloom.operators import stats as S
from corpusloom.plans.catalog import SQL_VIEWS, query, sql_canonical, sql_count, sql_matching, sql_squeeze, sql_sub, table

SAMPLES = """(1, 'Paid {$ 12.50} on XX/XX/2024 to XXXX   and XXXX. Call 555-123-4567!'), (2, 'COMPLAINT NARRATIVE: they did not refund me. I mean, I might sue'),
 (3, 'write to a.b@mail.example or 10.0.0.7 about account number 12345678'), (4, ''), (5, 'Subject: dispute
Dear team, I was charged twice. It was not mine but theirs!!'), (6, 'SSN 123-45-6789, http://x.example, NOT happy'), (7, 'Key facts: none
Timeline: last week
Pursuant to the statute, this violation')"""


def samples(spark):
    return spark.sql(f"SELECT CAST(id AS BIGINT) AS id, text FROM VALUES {SAMPLES} AS t(id, text)")


SQL_SAMPLES = f"samples AS (SELECT CAST(id AS BIGINT) AS id, text FROM (VALUES {SAMPLES}) AS t(id, text))"


@query("text_views", f"SELECT doc_id, sha256({sql_canonical('text')}) AS canonical_sha256, sha256({sql_matching(sql_canonical('text'))}) AS matching_sha256, sha256({sql_squeeze(sql_canonical('text'))}) AS lexical_sha256, CAST(length({sql_canonical('text')}) AS BIGINT) AS char_count FROM documents")
def text_views(spark, sf_dir):
    """TX5, TX8, TX9, FE1: canonical, matching and lexical views of every document."""
    canonical = X.canonical(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", canonical.alias("c"))
    return docs.select("doc_id", F.sha2("c", 256).alias("canonical_sha256"), F.sha2(X.matching(F.col("c")), 256).alias("matching_sha256"), F.sha2(X.lexical(F.col("c")), 256).alias("lexical_sha256"), F.length("c").cast("bigint").alias("char_count"))


@query("masked_samples", f"WITH {SQL_SAMPLES} SELECT id, {sql_canonical('text')} AS canonical, {sql_matching('text')} AS matching FROM samples")
def masked_samples(spark, sf_dir):
    """TX5, TX8 on texts with amounts, dates and redactions."""
    return samples(spark).select("id", X.canonical(F.col("text")).alias("canonical"), X.matching(F.col("text")).alias("matching"))


@query("core_section", f"WITH {SQL_SAMPLES} SELECT id, trim(CASE WHEN regexp_matches(text, '(?is)\\bcomplaint narrative\\s*:\\s*(.+)') THEN regexp_extract(text, '(?is)\\bcomplaint narrative\\s*:\\s*(.+)', 1) ELSE text END) AS core, regexp_matches(text, '(?is)\\bcomplaint narrative\\s*:\\s*(.+)') AS found FROM samples")
def core_section(spark, sf_dir):
    """TX4."""
    return samples(spark).select("id", X.core_section(F.col("text")).alias("c")).select("id", F.col("c.text").alias("core"), "c.found")


@query("byte_literals")
def byte_literals(spark, sf_dir):
    """TX1, TX2, TX3: byte literals unwrapped, failures typed. Needs Python's literal grammar, so no SQL."""
    rows = spark.createDataFrame([(1, "b'caf\\xc3\\xa9'"), (2, "b'\\xff'"), (3, "b'\\xzz'"), (4, "plain"), (5, 'b"it"'), (6, "b'a' + 'b'"), (7, None)], "id bigint, text string")
    strict, lenient = X.unwrapper(), X.unwrapper(lenient=True)
    return rows.select("id", strict("text").alias("s"), lenient("text").alias("l")).select("id", F.col("s.text").alias("text"), F.col("s.status").alias("status"), F.col("l.text").alias("lenient_text"))


@query("release_redaction", f"WITH {SQL_SAMPLES} SELECT id, " + sql_sub(sql_sub(sql_sub(sql_sub(sql_sub("text", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL]"), r"\b\d{3}-\d{3}-\d{4}\b", "[PHONE]"), r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"), r"(?i)\b(?:account|acct|card)\s*(?:number|no\.?|#)\s*\d{6,}\b", "[ACCOUNT]"), r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IPV4]") + " AS redacted FROM samples")
def release_redaction(spark, sf_dir):
    """TX19: ordered replacement of personal data."""
    return samples(spark).select("id", X.redact(F.col("text")).alias("redacted"))


@query("deterministic_keys", """SELECT doc_id, sha256('7|draw|' || CAST(doc_id AS VARCHAR)) AS joined_key, sha256('[7,"draw","' || CAST(doc_id AS VARCHAR) || '"]') AS json_key, 'seed-' || substr(sha256(CAST(doc_id AS VARCHAR) || '|' || source), 1, 16) AS stable_id FROM documents""")
def deterministic_keys(spark, sf_dir):
    """TX16, TX17: both key formats, and stable ids."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.key_joined(7, "draw", F.col("doc_id")).alias("joined_key"), X.key_json(7, "draw", F.col("doc_id")).alias("json_key"), X.stable_id("seed-", 16, F.col("doc_id"), F.col("source")).alias("stable_id"))


@query("reading_chunks", "SELECT doc_id, CAST(part AS BIGINT) AS part, sha256(substr(text, CAST(part * 3000 + 1 AS BIGINT), 3000)) AS part_sha256 FROM documents, LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil(length(text) / 3000.0) AS BIGINT)))) AS part)")
def reading_chunks(spark, sf_dir):
    """TX25, SK8: texts in parts of bounded length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 3000)).alias("part", "t"))
    return docs.select("doc_id", F.col("part").cast("bigint").alias("part"), F.sha2("t", 256).alias("part_sha256"))


SQL_LETTERS = "length(regexp_replace(c, '[^\\p{L}]', '', 'g'))"


@query("quality_features", f"WITH v AS (SELECT doc_id, {sql_canonical('text')} AS c FROM documents) SELECT doc_id, CAST(length(c) AS BIGINT) AS char_count, round(CASE WHEN {SQL_LETTERS} = 0 THEN 0.0 ELSE length(regexp_replace(c, '[^\\p{{Lu}}]', '', 'g')) / CAST({SQL_LETTERS} AS DOUBLE) END, 9) AS uppercase_ratio, length(c) < 100 AS very_short, length(c) > 5000 AS very_long, regexp_matches(c, '(?i)https?://|www\\.') AS contains_url, regexp_matches(c, '[!?.,-]{{4,}}') AS repeated_punctuation FROM v")
def quality_features(spark, sf_dir):
    """FE1, FE4, FE6, FE7."""
    c = F.col("c")
    docs = table(spark, sf_dir, "documents").select("doc_id", X.canonical(F.col("text")).alias("c"))
    return docs.select("doc_id", F.length("c").cast("bigint").alias("char_count"), F.round(V.uppercase_ratio(c), 9).alias("uppercase_ratio"), (F.length("c") < 100).alias("very_short"), (F.length("c") > 5000).alias("very_long"), c.rlike(V.URL).alias("contains_url"), c.rlike(V.REPEATED_PUNCTUATION).alias("repeated_punctuation"))



@query("sample_counts", f"WITH {SQL_SAMPLES}, v AS (SELECT id, {sql_canonical('text')} AS c FROM samples) SELECT id, {sql_count('c', r'\b[A-Za-z0-9]+(?:[’-][A-Za-z0-9]+)?\b')} AS word_count, greatest(1, {sql_count('c', r'[^.!?\n]+(?:[.!?]+|$)')}) AS sentence_count, {sql_count('c', r'\[REDACTED\]')} AS redactions, {sql_count('c', V.FORM_HEADER)} AS form_headers, {sql_count('c', V.LETTER_MARKER)} AS letter_markers, {sql_count('c', V.LEGAL_TERM)} AS legal_terms FROM v")
def sample_counts(spark, sf_dir):
    """FE1, FE2, FE5, TX22: counts of words, sentences, placeholders and markers."""
    c = F.col("c")
    n = lambda p, name: X.count(c, p).cast("bigint").alias(name)
    rows = samples(spark).select("id", X.canonical(F.col("text")).alias("c"))
    return rows.select("id", V.word_count(c).cast("bigint").alias("word_count"), V.sentence_count(c).cast("bigint").alias("sentence_count"), n(r"\[REDACTED\]", "redactions"), n(V.FORM_HEADER, "form_headers"), n(V.LETTER_MARKER, "letter_markers"), n(V.LEGAL_TERM, "legal_terms"))


def _sql_flag(pattern):
    return f"regexp_matches(text, '{pattern.replace(chr(39), chr(39) * 2)}')"


@query("detector_flags", f"WITH {SQL_SAMPLES} SELECT id, " + ", ".join(f"{_sql_flag(p)} AS {n}, {sql_count('text', p)} AS {n}_count" for n, p in V.DETECTORS.items()) + " FROM samples")
def detector_flags(spark, sf_dir):
    """FE10: seven lexical detectors, flags and counts."""
    found = V.detect(F.col("text"), V.word_count(F.col("text")), V.DETECTORS)
    return samples(spark).select("id", *[c.cast("bigint").alias(n) if n.endswith("_count") else c.alias(n) for n, c in found.items() if not n.endswith("words")])


def _sql_word(pattern):
    """A flag of a pattern between word borders that know all letters, which the SQL engine's own don't."""
    inner = pattern.replace("'", "''").removeprefix("(?i)").removeprefix("\\b").removesuffix("\\b")
    return f"regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_]){inner}(?:[^\\p{{L}}\\p{{N}}_]|$)')"


@query("detector_coverage", "SELECT lang, " + ", ".join(f"count(*) FILTER ({_sql_word(p)}) AS {n}" for n, p in (("no_or_on", r"(?i)\b(?:no|on)\b"), ("temporal", V.DETECTORS["temporal"]))) + ", count(*) AS n FROM documents GROUP BY lang")
def detector_coverage(spark, sf_dir):
    """FE10, AG13 over all documents by language, with one pattern of our own besides."""
    docs = table(spark, sf_dir, "documents")
    n = lambda p, name: F.count(F.when(F.col("text").rlike(p), 1)).alias(name)
    return docs.groupBy("lang").agg(n(r"(?i)\b(?:no|on)\b", "no_or_on"), n(V.DETECTORS["temporal"], "temporal"), F.count("*").alias("n"))


def sql_detect_count(x, pattern):
    """Matches; those that a pattern forbids to be followed are counted and taken off, as the SQL engine can't look ahead."""
    ahead = r"(?!\s+by\b)"
    return sql_count(x, pattern) if not pattern.endswith(ahead) else f"({sql_count(x, pattern.removesuffix(ahead))} - {sql_count(x, pattern.removesuffix(ahead) + r'\s+by\b')})"


_WORDS_SQL = sql_count("text", X.WORD)
_CAPITALS_SQL = f"""CAST(len(list_filter(regexp_extract_all(text, '\\b[A-Z]{{3,}}\\b'), lambda t: t NOT IN ({", ".join(f"'{c}'" for c in V.CAPITALS)}) AND NOT regexp_matches(t, '^X+$'))) AS BIGINT)"""


@query("extended_detectors", f"WITH {SQL_SAMPLES} SELECT id, " + ", ".join(f"{sql_detect_count('text', p)} > 0 AS {n}, {sql_detect_count('text', p)} AS {n}_count, CASE WHEN {_WORDS_SQL} = 0 THEN 0.0 ELSE 100.0::DOUBLE * {sql_detect_count('text', p)} / {_WORDS_SQL} END AS {n}_per_100_words" for n, p in V.EXTENDED.items()) + f", CASE WHEN {_WORDS_SQL} = 0 THEN 0.0 ELSE 100.0::DOUBLE * {sql_count('text', V.PRONOUN)} / {_WORDS_SQL} END AS pronouns_per_100, {_CAPITALS_SQL} AS capitals, {sql_count('text', V.EXPRESSIVE_PUNCTUATION)} AS expressive_punctuation FROM samples")
def extended_detectors(spark, sf_dir):
    """FE11: twelve detectors, pronoun rate, capitals and expressive punctuation."""
    t = F.col("text")
    words = V.word_count(t)
    found = V.detect(t, words, V.EXTENDED)
    return samples(spark).select("id", *[c.cast("bigint").alias(n) if n.endswith("_count") else c.alias(n) for n, c in found.items()], (100 * V.ratio(X.count(t, V.PRONOUN), words)).alias("pronouns_per_100"), V.capitals_emphasis(t).cast("bigint").alias("capitals"), X.count(t, V.EXPRESSIVE_PUNCTUATION).cast("bigint").alias("expressive_punctuation"))


PHONE_SQL = r"(?:^|[^0-9])(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?:[^0-9]|$)"
_PII_SQL = {"email": V.PII["email"], "phone": PHONE_SQL, "ssn": r"(?:^|[^0-9])\d{3}-\d{2}-\d{4}(?:[^0-9]|$)", "account_context": V.PII["account_context"], "ipv4": V.PII["ipv4"]}


@query("pii_types", "SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN {_sql_flag(p)} THEN '{n}' END" for n, p in _PII_SQL.items()) + ") AS pii_types FROM documents WHERE " + " OR ".join(_sql_flag(p) for p in _PII_SQL.values()))
def pii_types(spark, sf_dir):
    """FE8: kinds of personal data by pattern in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", V.matched_names(F.col("text"), V.PII)).alias("pii_types"))
    return docs.filter("pii_types <> ''")


@query("pii_release_types", f"WITH {SQL_SAMPLES} SELECT id, regexp_matches(text, '(?i)\\bhttps?://\\S+|\\bwww\\.\\S+') AS has_url, regexp_matches(text, '(?:^|[^0-9])\\d{{9,}}(?:[^0-9]|$)') AS long_digits FROM samples")
def pii_release_types(spark, sf_dir):
    """FE9: the wider patterns of a release check."""
    return samples(spark).select("id", F.col("text").rlike(V.PII_RELEASE["url"]).alias("has_url"), F.col("text").rlike(V.PII_RELEASE["long_digit_run"]).alias("long_digits"))


@query("bands", "SELECT doc_id, CASE WHEN n < 50 THEN '<50' WHEN n < 150 THEN '50-149' WHEN n < 400 THEN '150-399' WHEN n < 800 THEN '400-799' ELSE '>=800' END AS words_band, CASE WHEN n / 1000.0 <= 0.5 THEN 'low' WHEN n / 1000.0 <= 0.8 THEN 'middle' ELSE 'high' END AS score_band FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)")
def bands(spark, sf_dir):
    """PF11: right-closed and half-open bands."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n"))
    return docs.select("doc_id", V.words_band(F.col("n")).alias("words_band"), V.band(F.col("n") / 1000.0, (0.5, 0.8), ("low", "middle", "high")).alias("score_band"))


@query("registers", "SELECT doc_id, CASE WHEN doc_id % 7 >= 3 THEN 'template_letter_family' WHEN doc_id % 5 >= 2 THEN 'template_form' WHEN doc_id % 3 >= 1 THEN 'pasted_correspondence' WHEN doc_id % 11 >= 2 THEN 'legal_formal' ELSE 'consumer_narrative' END AS register FROM documents")
def registers(spark, sf_dir):
    """PF5 over counts made from ids, which reach every branch."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", V.register(k % 7, k % 5, k % 3, k % 11).alias("register"))


@query("registers_graded", "SELECT doc_id, CASE WHEN f >= 3 THEN 'template_letter_family' WHEN h >= 2 THEN 'template_form' WHEN l >= 1 OR a THEN 'pasted_correspondence' WHEN g >= 2 THEN 'legal_formal' ELSE 'consumer_narrative' END AS bucket, CASE WHEN f >= 3 OR h >= 2 THEN 'high' WHEN l >= 1 AND a THEN 'high' WHEN l >= 1 OR a THEN 'medium' WHEN g >= 4 THEN 'high' WHEN g >= 2 THEN 'medium' WHEN h = 1 OR g = 1 THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN f >= 3 THEN 'family_size=' || f WHEN h >= 2 THEN 'form_headers=' || h WHEN l >= 1 OR a THEN 'letter_markers=' || l || '|attachment=' || a WHEN g >= 2 THEN 'legal_terms=' || g WHEN h = 1 OR g = 1 THEN 'form_headers=' || h || '|legal_terms=' || g ELSE 'no_structural_marker' END AS evidence FROM (SELECT doc_id, doc_id % 4 AS f, doc_id % 5 % 3 AS h, doc_id % 7 % 2 AS l, doc_id % 9 = 1 AS a, doc_id % 11 % 6 AS g FROM documents)")
def registers_graded(spark, sf_dir):
    """PF6."""
    k = F.col("doc_id")
    graded = V.register_graded(k % 4, k % 5 % 3, k % 7 % 2, k % 9 == 1, k % 11 % 6)
    return table(spark, sf_dir, "documents").select("doc_id", graded.alias("g")).select("doc_id", "g.bucket", "g.confidence", "g.evidence")


@query("quality_scores", "SELECT doc_id, round(0.35::DOUBLE * least(1.0, CAST(doc_id % 4 AS DOUBLE) / 3) + 0.30 * least(1.0, CAST(doc_id % 6 AS DOUBLE) / 4) + 0.20 * greatest(0.0, 1 - CAST(doc_id % 5 AS DOUBLE) / 10 / 0.25) + 0.15 * least(1.0, n_chars / 1999.0::DOUBLE), 4) AS score FROM documents")
def quality_scores(spark, sf_dir):
    """FE17."""
    k = F.col("doc_id").cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", V.quality_score(k % 4, k % 6, k % 5 / 10, F.least(F.lit(1.0), F.col("n_chars") / 1999.0)).alias("score"))


@query("complexity_tiers", "SELECT doc_id, s AS score, CASE WHEN s <= 3 THEN 'simple' WHEN s <= 7 THEN 'medium' WHEN s <= 12 THEN 'complex' ELSE 'adversarial_high_risk' END AS tier FROM (SELECT doc_id, CAST(doc_id % 4 + doc_id % 3 + doc_id % 2 + 2 * (doc_id % 2) + 2 * CAST(doc_id % 5 = 0 AS INTEGER) + CAST(doc_id % 3 = 0 AS INTEGER) + 0.5 * least(8, doc_id % 11) + 2 * CAST(doc_id % 7 = 0 AS INTEGER) + CASE WHEN lang = 'fr' THEN 1.5 WHEN lang = 'de' THEN 1.2 ELSE 1.0 END AS DOUBLE) AS s FROM documents)")
def complexity_tiers(spark, sf_dir):
    """FE14."""
    k = F.col("doc_id")
    bucket = F.when(F.col("lang") == "fr", "legal_formal").when(F.col("lang") == "de", "template_form").otherwise("consumer_narrative")
    score = V.complexity(k % 4, k % 3, k % 2, k % 2, k % 5 == 0, k % 3 == 0, k % 11, k % 7 == 0, bucket).cast("double")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"))
    return docs.select("doc_id", "score", V.band(F.col("score"), V.COMPLEXITY_CUTS, V.COMPLEXITY_TIERS).alias("tier"))


@query("mattr", "WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS t FROM conversations) SELECT conv_id, turn, round(CASE WHEN len(t) >= 25 THEN list_avg([len(list_distinct(t[i:i+24])) / 25.0 FOR i IN range(1, len(t) - 23)]) END, 9) AS mattr FROM w")
def mattr(spark, sf_dir):
    """WN8, ST8: moving-average share of distinct tokens."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(F.array(F.struct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("t")))))
    return turns.select("conv_id", "turn", F.round(V.mattr(F.col("t")), 9).alias("mattr"))


@query("numeric_omission", "WITH m AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*'))) AS a, list_distinct(regexp_extract_all(substr(text, 1, 400), '\\d+(?:[.,]\\d+)*')) AS b FROM documents) SELECT doc_id, CAST(len(a) AS BIGINT) AS n_numbers, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS n_omitted FROM m WHERE len(a) > 0")
def numeric_omission(spark, sf_dir):
    """TX27: numbers of a text that its head lacks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.numbers(F.col("text")).alias("a"), X.numbers(F.substring("text", 1, 400)).alias("b"))
    return docs.filter(F.size("a") > 0).select("doc_id", F.size("a").cast("bigint").alias("n_numbers"), F.size(F.array_except("a", "b")).cast("bigint").alias("n_omitted"))


@query("grounding", f"SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+'))) >= {D.MIN_GROUNDING_TOKENS} AS enough FROM conversations")
def grounding(spark, sf_dir):
    """FE18: whether a turn has enough plain words."""
    words = F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Za-z0-9]+$"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.size(words) >= D.MIN_GROUNDING_TOKENS).alias("enough"))


@query("span_redaction", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Contact [PII_CANDIDATE] at [PII_CANDIDATE] about the disputed transfer.', CAST(2 AS BIGINT)), (CAST(2 AS BIGINT), 'no finding', CAST(0 AS BIGINT)), (CAST(3 AS BIGINT), '[PII_CANDIDATE]def', CAST(1 AS BIGINT))) AS t(id, redacted, n)")
def span_redaction(spark, sf_dir):
    """TX20, TX21: merged spans replaced; touching spans merge."""
    rows = spark.createDataFrame(
        [(1, "Contact Maria at maria@example.com about the disputed transfer.", [(17, 34), (8, 13)]), (2, "no finding", []), (3, "abcdef", [(0, 2), (2, 3)])],
        "id bigint, text string, spans array<struct<start: int, end: int>>",
    )
    merged = rows.select("id", "text", X.merge_spans(F.col("spans")).alias("m"))
    return merged.select("id", X.replace_spans(F.col("text"), F.col("m")).alias("redacted"), F.size("m").cast("bigint").alias("n"))


KEYWORD = "(?i)licen[cs]e[ds]?"


@query("keyword_contexts", f"""WITH p AS (SELECT doc_id, text, string_split_regex(text, '{KEYWORD}') AS g, regexp_extract_all(text, '{KEYWORD}') AS h FROM documents WHERE regexp_matches(text, '{KEYWORD}')),
k AS (SELECT doc_id, text, g, h, unnest(range(1, len(h) + 1)) AS i FROM p),
s AS (SELECT doc_id, text, h[i] AS keyword, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i - 1]]), 0) AS INTEGER) AS start FROM k)
SELECT doc_id, start, CAST(start + length(keyword) AS INTEGER) AS "end", substr(text, greatest(1, start - 39), least(40, start)) AS "left", keyword, substr(text, start + length(keyword) + 1, 40) AS "right" FROM s""")
def keyword_contexts(spark, sf_dir):
    """TX24, CF6: contexts around a keyword in all documents."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(KEYWORD)).select("doc_id", F.inline(F.array(F.struct(F.col("text").alias("text")))))
    return docs.select("doc_id", F.explode(X.contexts(F.col("text"), KEYWORD, 40)).alias("k")).select("doc_id", "k.*")


@query("language_status", "SELECT lang, status, count(*) AS n FROM (SELECT lang, CASE WHEN lang = 'en' AND c >= 0.8 THEN 'english' WHEN lang = 'en' AND c >= 0.5 THEN 'english_low_confidence' WHEN c >= 0.8 THEN 'other_language' ELSE 'uncertain' END AS status FROM (SELECT lang, (doc_id % 100) / 100.0 AS c FROM documents)) GROUP BY ALL")
def language_status(spark, sf_dir):
    """FE21, PF3."""
    docs = table(spark, sf_dir, "documents").select("lang", V.language_status(F.col("lang"), (F.col("doc_id") % 100) / 100.0).alias("status"))
    return docs.groupBy("lang", "status").agg(F.count("*").alias("n"))


@query("language_scores")
def language_scores(spark, sf_dir):
    """FE22: the scorer that stands in for a model file, against the label."""
    docs = table(spark, sf_dir, "documents").select("lang", V.language_scorer()("text").alias("s"))
    return docs.groupBy("lang", F.col("s.label").alias("label")).agg(F.count("*").alias("n"), F.avg("s.confidence").alias("confidence"))


@query("token_set_ratios")
def token_set_ratios(spark, sf_dir):
    """FE27 of neighbouring benchmark items."""
    items = table(spark, sf_dir, "benchmark")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return pairs.select("item_id", V.token_set_ratio()("text", "other").alias("ratio"))


@query("keyword_roles", "SELECT item_id, CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'article' WHEN regexp_matches(text, '(?i)\\bof\\b') THEN 'relation' ELSE 'other' END AS role, CAST(CAST(regexp_matches(text, '(?i)\\bthe\\b') AS INTEGER) + CAST(regexp_matches(text, '(?i)\\bof\\b') AS INTEGER) AS BIGINT) AS hits FROM benchmark")
def keyword_roles(spark, sf_dir):
    """PF9, FE13, FE20: role by the first keyword group, and the number of groups that match."""
    groups = {"article": r"(?i)\bthe\b", "relation": r"(?i)\bof\b"}
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", V.first_name(t, groups, "other").alias("role"), F.size(V.matched_names(t, groups)).cast("bigint").alias("hits"))


@query("eligibility_actions", """WITH a AS (SELECT doc_id, length(text) < 100 AS s, length(text) > 5000 AS l, source = 'src0' AS p, lang <> 'en' AS o FROM documents)
SELECT doc_id, CASE WHEN s THEN 'stress_only' WHEN o AND l THEN 'exclude' WHEN p THEN 'stress_only' WHEN o THEN 'exclude' ELSE 'retain' END AS seed_action,
CASE WHEN s THEN 'very_short' WHEN p THEN 'source' WHEN o THEN 'language' WHEN l THEN 'very_long' ELSE '' END AS seed_action_reason FROM (SELECT doc_id, s, l, p AND NOT s AS p, o AND NOT p AND NOT s AS o FROM a)""")
def eligibility_actions(spark, sf_dir):
    """PF2: ordered rules; one of them retains and stays open to later ones."""
    docs = table(spark, sf_dir, "documents")
    rules = [R.Rule("very_short", F.length("text") < 100, "stress_only"), R.Rule("very_long", F.length("text") > 5000, "retain"), R.Rule("source", F.col("source") == "src0", "stress_only"), R.Rule("language", F.col("lang") != "en", "exclude")]
    return R.apply_rules(docs, rules).select("doc_id", "seed_action", "seed_action_reason")


@query("frame_names", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'population' WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'overlap_enrichment' WHEN doc_id % 3 = 0 AND NOT doc_id % 7 = 0 THEN 'first_historical_enrichment' WHEN doc_id % 3 = 0 THEN 'first_outside_population_enrichment' ELSE 'second_historical_enrichment' END AS frame FROM documents")
def frame_names(spark, sf_dir):
    """PF4."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", R.sampling_frame(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("frame"))


@query("route_hints", "SELECT doc_id, CASE WHEN c = 0 THEN 'FCRA_credit_reporting_review' WHEN c = 1 THEN 'FDCPA_debt_validation_review' WHEN r = 0 THEN 'Reg_Z_FCBA_credit_card_billing_dispute' WHEN r < 3 THEN 'Reg_E_or_transfer_review_requires_facts' WHEN c = 2 THEN 'unknown_requires_payment_rail_and_card_type' ELSE 'nonfinal_triage_requires_human_review' END AS route FROM (SELECT doc_id, doc_id % 4 AS c, doc_id % 5 AS r FROM documents)")
def route_hints(spark, sf_dir):
    """PF8."""
    pick = lambda k, names: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    k = F.col("doc_id")
    claim, rail = pick(k % 4, ("credit_reporting_dispute", "debt_validation", "duplicate", "other")), pick(k % 5, ("credit_card", "wire", "ach", "cash", "cheque"))
    return table(spark, sf_dir, "documents").select("doc_id", R.route_hint(claim, rail).alias("route"))


@query("cell_taxonomy", "SELECT d.doc_id, coalesce(t.card, 'unknown') AS card, coalesce(t.in_scope, false) AS in_scope FROM documents d LEFT JOIN (VALUES ('en', 'src0', 'credit', true), ('fr', 'src0', 'debit', true), ('en', 'src1', 'prepaid', false)) AS t(lang, source, card, in_scope) ON d.lang = t.lang AND d.source = t.source")
def cell_taxonomy(spark, sf_dir):
    """PF7: a rule table joined as a struct."""
    rules = spark.createDataFrame([("en", "src0", "credit", True), ("fr", "src0", "debit", True), ("en", "src1", "prepaid", False)], "lang string, source string, card string, in_scope boolean")
    found = R.lookup_struct(table(spark, sf_dir, "documents"), rules, ["lang", "source"], "cell")
    return found.select("doc_id", F.coalesce("cell.card", F.lit("unknown")).alias("card"), F.coalesce("cell.in_scope", F.lit(False)).alias("in_scope"))


@query("wilson_flags", "WITH f AS (SELECT lang, unnest(['short', 'long']) AS flag, unnest([length(text) < 500, length(text) > 5000]) AS x FROM documents), s AS (SELECT lang, flag, count(*) AS n, count(*) FILTER (x) AS positive FROM f GROUP BY ALL), p AS (SELECT *, positive / n AS p, 1 + 1.959964 * 1.959964 / n AS d FROM s) SELECT lang, flag, n, positive, round(p, 9) AS rate, round((p + 1.959964 * 1.959964 / (2 * n)) / d - 1.959964 * sqrt(p * (1 - p) / n + 1.959964 * 1.959964 / (4 * n * n)) / d, 9) AS low, round((p + 1.959964 * 1.959964 / (2 * n)) / d + 1.959964 * sqrt(p * (1 - p) / n + 1.959964 * 1.959964 / (4 * n * n)) / d, 9) AS high FROM p")
def wilson_flags(spark, sf_dir):
    """AG4, AG5: flag rates with Wilson bounds per language, in long form."""
    docs = table(spark, sf_dir, "documents").select("lang", (F.length("text") < 500).alias("short"), (F.length("text") > 5000).alias("long"))
    found = S.flag_summary(docs, ["short", "long"], ["lang"])
    return found.select("lang", "flag", "n", "positive", *[F.round(c, 9).alias(c) for c in ("rate", "low", "high")])
