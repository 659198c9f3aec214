"""Queries over statistics: detector metrics, agreement, quantiles, distributions, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import relational as J
from corpusloom.operators import stats as S
from corpusloom.operators import textstats as T
from corpusloom.operators.storage import saved
from corpusloom.plans.catalog import query, table

SQL_GOLD = "g AS (SELECT l.doc_id, d.lang, l.toxic = 1 AS gold, regexp_matches(d.text, '(?i)idiot|worthless|pathetic') AS found, l.quality FROM labels l JOIN documents d USING (doc_id))"


def gold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").rlike("(?i)idiot|worthless|pathetic").alias("found"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("gold", F.col("toxic") == 1)


@query("detector_metrics", f"WITH {SQL_GOLD}, s AS (SELECT lang, count(*) FILTER (gold AND found) AS tp, count(*) FILTER (NOT gold AND found) AS fp, count(*) FILTER (gold AND NOT found) AS fn, count(*) FILTER (NOT gold AND NOT found) AS tn FROM g GROUP BY lang) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM s")
def detector_metrics(spark, sf_dir):
    """AG17, JN2."""
    found = S.precision_recall(gold(spark, sf_dir), F.col("gold"), F.col("found"), ["lang"])
    return found.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("label_kappa", "WITH r AS (SELECT CAST(quality AS VARCHAR) AS a, CAST(1 - toxic AS VARCHAR) AS b FROM labels), s AS (SELECT count(*) AS n, avg((a = b)::INTEGER) AS po, avg((a = '1')::INTEGER) * avg((b = '1')::INTEGER) + avg((a = '0')::INTEGER) * avg((b = '0')::INTEGER) AS pe FROM r) SELECT n, round(po, 9) AS agreement, round((po - pe) / (1 - pe), 9) AS kappa FROM s")
def label_kappa(spark, sf_dir):
    """AG19."""
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("a"), (1 - F.col("toxic")).cast("string").alias("b"))
    return S.kappa(rows, "a", "b", ["0", "1"]).select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("binary_agreement", f"WITH {SQL_GOLD}, s AS (SELECT lang, count(*) FILTER (gold AND found)::DOUBLE AS b, count(*) FILTER (gold AND NOT found)::DOUBLE AS x, count(*) FILTER (NOT gold AND found)::DOUBLE AS y, count(*) FILTER (NOT gold AND NOT found)::DOUBLE AS n FROM g GROUP BY lang) SELECT lang, round(2 * b / (2 * b + x + y), 9) AS positive_agreement, round(2 * n / (2 * n + x + y), 9) AS negative_agreement, round(2 * (b + n) / (b + n + x + y) - 1, 9) AS pabak FROM s")
def binary_agreement(spark, sf_dir):
    """AG20."""
    found = S.binary_agreement(gold(spark, sf_dir), F.col("gold"), F.col("found"), ["lang"])
    return found.select("lang", *[F.round(c, 9).alias(c) for c in ("positive_agreement", "negative_agreement", "pabak")])


@query("label_sets", "WITH s AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS g, list_filter([CASE WHEN doc_id % 3 > 0 THEN 'good' END, CASE WHEN doc_id % 5 = 0 THEN 'toxic' END], lambda x: x IS NOT NULL) AS f FROM labels), m AS (SELECT CAST(sum(len(list_intersect(g, f))) AS BIGINT) AS tp, CAST(sum(len(f)) AS BIGINT) AS nf, CAST(sum(len(g)) AS BIGINT) AS ng, avg((list_sort(g) = list_sort(f))::INTEGER) AS e, avg(CASE WHEN len(list_distinct(list_concat(g, f))) = 0 THEN 1.0 ELSE len(list_intersect(g, f))::DOUBLE / len(list_distinct(list_concat(g, f))) END) AS j FROM s) SELECT tp, nf - tp AS fp, ng - tp AS fn, round(e, 9) AS exact_set_accuracy, round(tp / nf, 9) AS precision, round(tp / ng, 9) AS recall, round(2 * tp / (nf + ng), 9) AS f1, round(j, 9) AS mean_jaccard FROM m")
def label_sets(spark, sf_dir):
    """AG18, AG21: micro metrics over label sets, and their mean overlap."""
    pick = lambda *c: F.array_compact(F.array(*c))
    rows = table(spark, sf_dir, "labels").select(
        pick(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")).alias("g"), pick(F.when(F.col("doc_id") % 3 > 0, "good"), F.when(F.col("doc_id") % 5 == 0, "toxic")).alias("f")
    )
    found = J.beside(S.label_set_metrics(rows, "g", "f"), rows.agg(F.avg(S.set_jaccard(F.col("g"), F.col("f"))).alias("mean_jaccard")))
    return found.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("exact_set_accuracy", "precision", "recall", "f1", "mean_jaccard")])


SQL_RULINGS = """r AS (SELECT l.doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'rejected' ELSE 'kept' END AS decision, list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS gold,
list_filter([CASE WHEN regexp_matches(text, '(?i)idiot|worthless|pathetic') THEN 'toxic' END], lambda x: x IS NOT NULL) AS judge, list_filter([CASE WHEN regexp_matches(text, '(?i)idiot|worthless|pathetic') THEN 'toxic' END, CASE WHEN contains(text, '###') OR length(text) < 200 THEN 'low_quality' END], lambda x: x IS NOT NULL) AS combined FROM labels l JOIN documents d USING (doc_id))"""
_SQL_RATES = "round(tp / (tp + fp), 9) AS reject_precision, round(tp / (tp + fn), 9) AS reject_recall, round(2 * tp / (2 * tp + fp + fn), 9) AS reject_f1"


def rulings(spark, sf_dir):
    """Gold decisions and labels, those of a judge that knows insults alone, and those with rules besides."""
    pick = lambda *c: F.array_compact(F.array(*c))
    insult, thin = F.when(F.col("text").rlike("(?i)idiot|worthless|pathetic"), "toxic"), F.when(F.contains("text", F.lit("###")) | (F.length("text") < 200), "low_quality")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return rows.select("doc_id", F.when(bad | toxic, "rejected").otherwise("kept").alias("decision"), pick(F.when(bad, "low_quality"), F.when(toxic, "toxic")).alias("gold"), pick(insult).alias("judge"), pick(insult, thin).alias("combined"))


@query("decision_metrics", f"WITH {SQL_RULINGS}, s AS (SELECT count(*) AS n, avg((decision = CASE WHEN len(combined) > 0 THEN 'rejected' ELSE 'kept' END)::INTEGER) AS a, count(*) FILTER (decision = 'rejected' AND len(combined) > 0) AS tp, count(*) FILTER (decision <> 'rejected' AND len(combined) > 0) AS fp, count(*) FILTER (decision = 'rejected' AND len(combined) = 0) AS fn FROM r) SELECT n, round(a, 9) AS accuracy, {_SQL_RATES} FROM s")
def decision_metrics(spark, sf_dir):
    """AG18: accuracy, and precision, recall and F1 of rejection."""
    found = S.decision_metrics(rulings(spark, sf_dir), F.col("decision"), F.when(F.size("combined") > 0, "rejected").otherwise("kept"))
    return found.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "reject_precision", "reject_recall", "reject_f1")])


def _sql_view(view):
    both = f"len(list_intersect(gold, {view}))"
    return f"""SELECT '{view}' AS view, CAST(b AS BIGINT) AS tp, CAST(f - b AS BIGINT) AS fp, CAST(g - b AS BIGINT) AS fn, round(e, 9) AS exact_set_accuracy, round(b / f, 9) AS precision, round(b / g, 9) AS recall, round(2 * b / (f + g), 9) AS f1, round(a, 9) AS accuracy, {_SQL_RATES.replace('tp', 't').replace('fp', 'p').replace('fn', 'm')}
FROM (SELECT sum({both}) AS b, sum(len({view})) AS f, sum(len(gold)) AS g, avg(({both} = len(gold) AND {both} = len({view}))::INTEGER) AS e, avg(((decision = 'rejected') = (len({view}) > 0))::INTEGER) AS a,
count(*) FILTER (decision = 'rejected' AND len({view}) > 0) AS t, count(*) FILTER (decision <> 'rejected' AND len({view}) > 0) AS p, count(*) FILTER (decision = 'rejected' AND len({view}) = 0) AS m FROM r)"""


@query("judge_views", f"WITH {SQL_RULINGS} " + " UNION ALL ".join(map(_sql_view, ("judge", "combined"))))
def judge_views(spark, sf_dir):
    """GV20: a judge alone against the judge combined with rules."""
    found = S.compared_judges(rulings(spark, sf_dir), "gold", {"judge": "judge", "combined": "combined"}, "decision")
    return found.select("view", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in found.columns[4:]])


@query("char_quantiles", "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, round(stddev_samp(n_chars) / avg(n_chars), 6) AS cv, min(n_chars) AS min, max(n_chars) AS max, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM documents GROUP BY lang")
def char_quantiles(spark, sf_dir):
    """AG1, AG8, AG9."""
    found = S.describe(table(spark, sf_dir, "documents"), "n_chars", ["lang"])
    return found.select("lang", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "cv", "p05", "p25", "p50", "p75", "p95", "p99")])


@query("weighted_quantiles", "WITH r AS (SELECT o_totalprice AS x, CAST(1 + o_custkey % 3 AS DOUBLE) AS w, row_number() OVER (ORDER BY o_totalprice, 1 + o_custkey % 3) AS k FROM orders), c AS (SELECT x, (sum(w) OVER (ORDER BY k) - w / 2) / sum(w) OVER () AS p, k FROM r), d AS (SELECT x, p, lead(x) OVER (ORDER BY k) AS x2, lead(p) OVER (ORDER BY k) AS p2 FROM c) SELECT CAST(q AS DOUBLE) AS q, round((SELECT max(x + (x2 - x) * (q - p) / (p2 - p)) FROM d WHERE p <= q AND p2 > q), 4) AS value FROM (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS t(q)")
def weighted_quantiles(spark, sf_dir):
    """AG10, WN7."""
    rows = table(spark, sf_dir, "orders").select("o_totalprice", (1 + F.col("o_custkey") % 3).cast("double").alias("w"))
    return S.weighted_quantiles(rows, "o_totalprice", "w", [0.25, 0.5, 0.9]).select("q", F.round("value", 4).alias("value"))


@query("weighted_rates", "SELECT lang, round(sum((length(text) < 1000)::INTEGER * (1.0 + doc_id % 4)) / sum(1.0 + doc_id % 4), 9) AS rate, CAST(sum(1 + doc_id % 4) AS BIGINT) AS weight FROM documents GROUP BY lang")
def weighted_rates(spark, sf_dir):
    """AG11."""
    w = 1 + F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(S.weighted_rate(F.length("text") < 1000, w), 9).alias("rate"), F.sum(w).alias("weight"))


@query("histogram_gate", "WITH h AS (SELECT lang, doc_id % 2 AS side, [count(*) FILTER (n_chars <= 500), count(*) FILTER (n_chars > 500 AND n_chars <= 2000), count(*) FILTER (n_chars > 2000)] AS b FROM documents GROUP BY ALL), p AS (SELECT a.lang, [x + 1e-12 FOR x IN a.b] AS p, [x + 1e-12 FOR x IN b.b] AS q FROM h a JOIN h b ON a.lang = b.lang AND a.side = 0 AND b.side = 1), n AS (SELECT lang, [x / list_sum(p) FOR x IN p] AS p, [x / list_sum(q) FOR x IN q] AS q FROM p) SELECT lang, round((list_sum([p[i] * log2(2 * p[i] / (p[i] + q[i])) FOR i IN [1, 2, 3]]) + list_sum([q[i] * log2(2 * q[i] / (p[i] + q[i])) FOR i IN [1, 2, 3]])) / 2, 9) AS divergence FROM n")
def histogram_gate(spark, sf_dir):
    """AG29: divergence of two histograms."""
    n = F.col("n_chars")
    bins = {"a": n <= 500, "b": (n > 500) & (n <= 2000), "c": n > 2000}
    even = F.col("doc_id") % 2 == 0
    sums = table(spark, sf_dir, "documents").groupBy("lang").agg(*[F.count(F.when(t & s, 1)).alias(f"{k}{j}") for k, t in bins.items() for j, s in ((0, even), (1, ~even))])
    side = lambda j: [F.col(f"{k}{j}") for k in bins]
    return sums.select("lang", F.round(S.jensen_shannon(side(0), side(1)), 9).alias("divergence"))


@query("rate_gates", "SELECT lang, abs(avg((n_chars < 1000)::INTEGER) - 0.3) <= greatest(0.10, 2.5 * sqrt(0.3 * 0.7 / count(*))) AS within FROM documents GROUP BY lang")
def rate_gates(spark, sf_dir):
    """AG29: a rate's tolerance."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(S.rate_gate(F.avg((F.col("n_chars") < 1000).cast("int")), F.lit(0.3), F.count("*")).alias("within"))


@query("split_table", "WITH c AS (SELECT lang, count(*) FILTER (doc_id % 4 < 3) AS n_train, count(*) FILTER (doc_id % 4 = 3) AS n_test FROM documents GROUP BY lang), s AS (SELECT *, n_train / sum(n_train) OVER () AS share_train, n_test / sum(n_test) OVER () AS share_test FROM c) SELECT lang, n_train, n_test, round(share_train, 9) AS share_train, round(share_test, 9) AS share_test, round(share_train / share_test, 9) AS ratio, round(abs(share_train - share_test), 9) AS gap FROM s")
def split_table(spark, sf_dir):
    """AG12, AG26: a category's shares by split."""
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 4 < 3, "train").otherwise("test"))
    found = S.split_table(docs, "lang", "split", ["train", "test"])
    return found.select("lang", "n_train", "n_test", *[F.round(c, 9).alias(c) for c in ("share_train", "share_test", "ratio", "gap")])


@query("conflict_columns", "WITH s AS (SELECT doc_id % 50 AS k, lang, CASE WHEN doc_id % 50 < 10 THEN 'same' WHEN doc_id % 3 > 0 THEN source END AS src FROM documents), g AS (SELECT k, count(*) AS n_rows, count(DISTINCT lang) + max((lang IS NULL)::INTEGER) > 1 AS a, count(DISTINCT src) + max((src IS NULL)::INTEGER) > 1 AS b FROM s GROUP BY k) SELECT k, n_rows, concat_ws('|', CASE WHEN a THEN 'lang' END, CASE WHEN b THEN 'src' END) AS conflict_columns FROM g WHERE a OR b")
def conflict_columns(spark, sf_dir):
    """AG25: which columns differ within a key."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("k"), "lang", F.when(F.col("doc_id") % 50 < 10, "same").when(F.col("doc_id") % 3 > 0, F.col("source")).alias("src"))
    return S.conflicts(rows, "k", ["lang", "src"])


@query("membership_hashes", "SELECT lang, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS members, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM documents GROUP BY lang")
def membership_hashes(spark, sf_dir):
    """AG24, AG30, TX18."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(S.membership_hash("doc_id").alias("members"), S.joined_set("source").alias("sources"))


@query("mode_values", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source AS mode, n AS mode_count FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM c) WHERE k = 1")
def mode_values(spark, sf_dir):
    """AG16."""
    return S.mode_value(table(spark, sf_dir, "documents"), ["lang"], "source")


# Term statistics run over all documents; a term is two letters or more, with or without accents.
LETTERS = "[a-zà-öø-ÿ]{2,}"
SQL_TERMS = f"""t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{LETTERS}'), lambda x: x NOT IN ({', '.join(f"'{s}'" for s in T.STOP_WORDS)})) AS t FROM documents),
w AS (SELECT doc_id, unnest(t) AS term FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL)"""
SQL_PAIRED = SQL_TERMS.replace("w AS (SELECT doc_id, unnest(t) AS term FROM t)", "w AS (SELECT doc_id, unnest(t) AS term FROM t UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t))")


def tokens(spark, sf_dir, stop=T.STOP_WORDS):
    """(doc_id, t): the words of each document, computed once a row."""
    # the engine lower-cases a dotted capital I to two characters, the second no letter; SQL to i
    found = F.regexp_extract_all(F.lower(F.replace("text", F.lit("\u0130"), F.lit("i"))), F.lit(LETTERS), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(F.struct((F.filter(found, lambda t: ~t.isin(*stop)) if stop else found).alias("t")))))


def terms(spark, sf_dir, sizes=(1,), stop=T.STOP_WORDS):
    return T.counted_grams(tokens(spark, sf_dir, stop), "doc_id", F.col("t"), sizes)


@query("mean_tfidf", f"WITH {SQL_PAIRED}, n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.85 * (SELECT n FROM n) ORDER BY cf DESC, term LIMIT 10000), x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM tf JOIN d USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id), m AS (SELECT term, sum(w / norm) / (SELECT n FROM n) AS s, count(*) AS df FROM x JOIN l USING (doc_id) GROUP BY term) SELECT term, round(s, 9) AS mean_tfidf, df FROM m ORDER BY s DESC, term LIMIT 100")
def mean_tfidf(spark, sf_dir):
    """ST1, ST7, SO2: words and pairs of words, the 10,000 most frequent of those neither rare nor everywhere; the terms of the largest mean weight."""
    n = tokens(spark, sf_dir).filter((F.size("t") > 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct().count()
    return T.mean_tfidf(T.tfidf(terms(spark, sf_dir, (1, 2)), n, "doc_id", min_df=5, max_df=0.85, max_terms=10_000), n).select("term", F.round("mean_tfidf", 9).alias("mean_tfidf"), "df")


@query("keyness", f"WITH {SQL_TERMS}, c AS (SELECT term, sum(tf)::DOUBLE AS c, coalesce(sum(tf) FILTER (doc_id % 2 = 0), 0)::DOUBLE AS a, coalesce(sum(tf) FILTER (doc_id % 2 = 1), 0)::DOUBLE AS b FROM tf GROUP BY term), s AS (SELECT *, sum(c) OVER () AS cc, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c), k AS (SELECT *, c * 1000 / cc AS al FROM s) SELECT term, CAST(a AS BIGINT) AS count_a, CAST(b AS BIGINT) AS count_b, round((ln(a + al) - ln(na + 1000 - a - al) - ln(b + al) + ln(nb + 1000 - b - al)) / sqrt(1 / (a + al) + 1 / (b + al)), 6) AS z FROM k WHERE c >= 20")
def keyness(spark, sf_dir):
    """ST3: log odds with an informative prior."""
    tf = terms(spark, sf_dir).withColumn("side", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    return T.keyness(tf, "side", "a", "b").filter(F.col("count_a") + F.col("count_b") >= 20).select("term", "count_a", "count_b", F.round("z", 6).alias("z"))


@query("ngram_counts", f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{LETTERS}') AS t FROM documents), g AS (SELECT doc_id, t[i] || ' ' || t[i+1] AS term FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM w) UNION ALL SELECT doc_id, t[i] || ' ' || t[i+1] || ' ' || t[i+2] FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM w)) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 10")
def ngram_counts(spark, sf_dir):
    """ST4: two and three words in a row with their document frequency."""
    return T.frequent_ngrams(tokens(spark, sf_dir, ()), "doc_id", F.col("t"), (2, 3), 10)


@query("term_rates", f"WITH {SQL_TERMS} SELECT term, CAST(sum(tf) AS BIGINT) AS n, round(sum(tf) * 10000.0 / (SELECT sum(tf) FROM tf), 6) AS per_10k FROM tf GROUP BY term HAVING sum(tf) >= 20")
def term_rates(spark, sf_dir):
    """ST6: frequencies per ten thousand words."""
    tf = terms(spark, sf_dir)
    total = tf.agg(F.sum("tf").alias("total"))
    counts = J.beside(tf.groupBy("term").agg(F.sum("tf").alias("n")), total)
    return T.per_ten_thousand(counts, "n", F.col("total")).select("term", "n", F.round("per_10k", 6).alias("per_10k"))


@query("top_terms", f"WITH {SQL_TERMS}, s AS (SELECT doc_id % 3 AS g, term, CAST(sum(tf) AS DOUBLE) AS score FROM tf GROUP BY ALL) SELECT g, term, score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term) AS r FROM s) WHERE r <= 15")
def top_terms(spark, sf_dir):
    """ST2: the leading terms of each group."""
    tf = terms(spark, sf_dir).select((F.col("doc_id") % 3).alias("g"), "term", F.col("tf").cast("double").alias("weight"))
    return T.top_terms(tf, "g", 15).select("g", "term", "score")


@query("repeated_phrases", "WITH s AS (SELECT item_id, unnest(regexp_extract_all(text, '[^.!?\\n]+')) AS s FROM benchmark), w AS (SELECT item_id, regexp_extract_all(lower(s), '[a-z0-9'']+') AS t FROM s), g AS (SELECT item_id, 3 AS n, t[i] || ' ' || t[i+1] || ' ' || t[i+2] AS phrase FROM (SELECT item_id, t, unnest(range(1, len(t) - 1)) AS i FROM w WHERE len(t) >= 3)) SELECT n, phrase, count(*) AS uses, count(DISTINCT item_id) AS cases FROM g GROUP BY ALL HAVING count(DISTINCT item_id) >= 2")
def repeated_phrases(spark, sf_dir):
    """ST5: phrases within a sentence that several cases share."""
    from corpusloom.functions.text import sentences

    return T.repeated_phrases(table(spark, sf_dir, "benchmark"), "item_id", sentences(F.col("text")), (3,))


@query("paired_cosines", f"WITH {SQL_TERMS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), d AS (SELECT term, count(*) AS df FROM tf GROUP BY term), x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM tf JOIN d USING (term)), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x), p AS (SELECT DISTINCT a.doc_id AS a, a.doc_id + 1 AS b FROM u a) SELECT p.a, p.b, round(coalesce(sum(x.w * y.w), 0), 9) AS cosine FROM p LEFT JOIN u x ON x.doc_id = p.a LEFT JOIN u y ON y.doc_id = p.b AND y.term = x.term GROUP BY p.a, p.b")
def paired_cosines(spark, sf_dir):
    """DU13: TF-IDF cosine of given pairs."""
    rows = T.one_row_a_key(tokens(spark, sf_dir), "doc_id", F.col("t"))
    pairs = saved(rows.filter(F.size("t") > 0).select(F.col("k").alias("a"), (F.col("k") + 1).alias("b")))
    n = pairs.filter("a is not null").count()
    return T.text_cosines(rows, n, pairs).select("a", "b", F.round("cosine", 9).alias("cosine"))


@query("reference_distribution", "SELECT 'unweighted' AS block, lang, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY lang UNION ALL SELECT 'weighted', lang, round(sum(1.0 + doc_id % 4) / (SELECT sum(1.0 + doc_id % 4) FROM documents), 9) FROM documents GROUP BY lang")
def reference_distribution(spark, sf_dir):
    """AG14, CF11, CF12: unweighted and weighted shares."""
    docs = table(spark, sf_dir, "documents").withColumn("w", 1.0 + F.col("doc_id") % 4)
    out = None
    for block, x in (("unweighted", F.count("*").cast("double")), ("weighted", F.sum("w"))):
        sums = docs.groupBy("lang").agg(x.alias("x"))
        part = J.beside(sums, docs.agg(x.alias("total"))).select(F.lit(block).alias("block"), "lang", F.round(F.col("x") / F.col("total"), 9).alias("share"))
        out = part if out is None else out.union(part)
    return out
