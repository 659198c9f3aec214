"""Queries over exact, template-level and fuzzy duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import duplicates as U
from corpusloom.operators import relational as J
from corpusloom.operators import sampling as A
from corpusloom.operators import stats as S
from corpusloom.operators.storage import saved
from corpusloom.plans.catalog import SQL_VIEWS, query, table


def features(spark, sf_dir, make=U.duplicate_features):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.length("text") < 500).alias("short"), (F.trim("text") == "").alias("blank"), "text", X.canonical(F.col("text")).alias("canonical"))
    return make(docs, "doc_id", "text", "canonical")


@query("duplicate_groups", f"WITH {SQL_VIEWS}, g AS (SELECT doc_id, family_signature, eligible, count(*) OVER (PARTITION BY raw_sha256) AS exact_raw_size, count(*) OVER (PARTITION BY canonical_sha256) AS exact_canonical_size, count(*) OVER (PARTITION BY family_signature) AS family_size FROM families) SELECT doc_id, family_signature, eligible AS family_eligible, exact_raw_size, exact_canonical_size, family_size, 1.0::DOUBLE / family_size AS family_equal_weight, exact_raw_size > 1 AS is_exact_duplicate FROM g")
def duplicate_groups(spark, sf_dir):
    """DU1, DU2, TX14, WN1, WN9."""
    return features(spark, sf_dir).select("doc_id", "family_signature", "family_eligible", "exact_raw_size", "exact_canonical_size", "family_size", "family_equal_weight", "is_exact_duplicate")


@query("duplicate_summary", f"WITH {SQL_VIEWS}, s AS (SELECT *, count(*) OVER (PARTITION BY family_signature) AS family_size FROM families) SELECT lang, count(*) AS n, count(DISTINCT raw_sha256) AS distinct_raw, count(DISTINCT canonical_sha256) AS distinct_canonical, count(DISTINCT family_signature) AS families, max(family_size) AS largest_family FROM s GROUP BY lang")
def duplicate_summary(spark, sf_dir):
    """AG7, and the flagship: text views, hashes, families and their summary per language."""
    return features(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("raw_sha256").alias("distinct_raw"), F.countDistinct("canonical_sha256").alias("distinct_canonical"), F.countDistinct("family_signature").alias("families"), F.max("family_size").alias("largest_family"))


@query("old_signatures", "WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM documents) SELECT doc_id, sha1(substr(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), 1, 400)) AS signature FROM m")
def old_signatures(spark, sf_dir):
    """TX15: the older signature over the first characters."""
    return table(spark, sf_dir, "documents").select("doc_id", X.family_signature_prefix(F.col("text")).alias("signature"))


@query("prevalence_views", f"WITH {SQL_VIEWS}, m AS (SELECT length(text) < 500 AS x, row_number() OVER (PARTITION BY raw_sha256 ORDER BY doc_id) AS e, row_number() OVER (PARTITION BY family_signature ORDER BY doc_id) AS f, 1.0::DOUBLE / count(*) OVER (PARTITION BY family_signature) AS w FROM families) SELECT view, round(rate, 9) AS rate FROM (SELECT avg(x::INTEGER) AS raw, avg(x::INTEGER) FILTER (e = 1) AS exact_dedup, avg(x::INTEGER) FILTER (f = 1) AS family_representative, sum(x::INTEGER * w) / sum(w) AS family_equal_weight FROM m) UNPIVOT (rate FOR view IN (raw, exact_dedup, family_representative, family_equal_weight))")
def prevalence_views(spark, sf_dir):
    """AG6: a flag's rate in four views of the corpus."""
    return S.prevalence_views(features(spark, sf_dir, U.signatures), "short", "raw_sha256", "family_signature", "doc_id").select("view", F.round("rate", 9).alias("rate"))


@query("corpus_views", f"WITH {SQL_VIEWS}, a AS (SELECT *, row_number() OVER (PARTITION BY canonical_sha256 ORDER BY doc_id) AS e FROM families WHERE trim(canonical) <> ''), b AS (SELECT *, row_number() OVER (PARTITION BY family_signature ORDER BY doc_id) AS f FROM a WHERE e = 1) SELECT 'all' AS view, count(*) AS n FROM a UNION ALL SELECT 'exact_dedup', count(*) FROM b UNION ALL SELECT 'family_dedup', count(*) FROM b WHERE f = 1")
def corpus_views(spark, sf_dir):
    """CF1: non-empty, exact-deduplicated and family-deduplicated views."""
    rows = features(spark, sf_dir, U.signatures).filter("not blank").select("doc_id", "canonical_sha256", "family_signature")
    exact = J.top_per_key(rows, ["canonical_sha256"], ["doc_id"]).drop("rank_in_group")
    family = J.top_per_key(exact, ["family_signature"], ["doc_id"]).drop("rank_in_group")
    n = lambda d, v: d.agg(F.count("*").alias("n")).select(F.lit(v).alias("view"), "n")
    return n(rows, "all").union(n(exact, "exact_dedup")).union(n(family, "family_dedup"))


_TOKENS_SQL = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')"
#: Shingle sets of five words of benchmark items and documents in full, over those with 16 shingles at least, equal sets as one.
SQL_SHINGLES = f"""t AS (SELECT doc_id AS k, {_TOKENS_SQL} AS w FROM documents),
s AS (SELECT DISTINCT k, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS h FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
full_sets AS (SELECT k, count(*) AS n, list_sort(list(h)) AS hs FROM s GROUP BY k HAVING count(*) >= 16),
sets AS (SELECT min(k) AS k, any_value(n) AS n, hs FROM full_sets GROUP BY hs),
r AS (SELECT s.k, s.h, sets.n FROM s JOIN sets ON s.k = sets.k),
pairs AS (SELECT a.k AS a, b.k AS b, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS jaccard FROM r a JOIN r b ON a.h = b.h AND a.k < b.k GROUP BY a.k, b.k HAVING count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) >= 0.5)"""


#: Links between similar sets, and between texts with one set.
SQL_LINKS = f"""{SQL_SHINGLES}, links AS (SELECT a, b FROM pairs WHERE jaccard >= 0.8 UNION ALL SELECT s.k, f.k FROM full_sets f JOIN sets s ON f.hs = s.hs WHERE f.k <> s.k),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(node, m) AS (SELECT a, a FROM e UNION SELECT e.b, reach.m FROM reach JOIN e ON reach.node = e.a), c AS (SELECT node, min(m) AS component FROM reach GROUP BY node)"""


def words_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(F.struct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "").alias("w")))))


def pairs_of(spark, sf_dir, threshold):
    return U.shingle_pairs(words_of(spark, sf_dir), "doc_id", F.col("w"), threshold=threshold)


def links_of(spark, sf_dir, threshold=0.8):
    return U.similar_links(words_of(spark, sf_dir), "doc_id", F.col("w"), threshold=threshold)


@query("shingle_pairs", f"WITH {SQL_SHINGLES} SELECT a, b, round(jaccard, 9) AS jaccard FROM pairs WHERE jaccard >= 0.8")
def shingle_pairs(spark, sf_dir):
    """DU3, JN10, SE4, TX12: pairs of shingle sets that overlap by 0.8 or more, exact; equal sets stand as one."""
    return pairs_of(spark, sf_dir, 0.8).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("shingle_members", f"WITH {SQL_SHINGLES} SELECT f.k AS doc_id, s.k AS representative FROM full_sets f JOIN sets s ON f.hs = s.hs")
def shingle_members(spark, sf_dir):
    """DU3: which text stands for each in the pairs."""
    sets = U.shingle_sets(words_of(spark, sf_dir), "doc_id", F.col("w"))
    return U.set_members(sets).select(F.col("k").alias("doc_id"), "representative")


@query("fuzzy_components", f"WITH RECURSIVE {SQL_LINKS} SELECT node, component FROM c")
def fuzzy_components(spark, sf_dir):
    """DU5, DU6: components of the pairs and of texts with one set, named by their smallest member."""
    return U.components(links_of(spark, sf_dir))


@query("similarity_bands", f"WITH {SQL_SHINGLES} SELECT CASE WHEN jaccard <= 0.5 THEN '<=0.50' WHEN jaccard <= 0.7 THEN '0.50-0.70' WHEN jaccard <= 0.8 THEN '0.70-0.80' WHEN jaccard <= 0.9 THEN '0.80-0.90' ELSE '>0.90' END AS band, count(*) AS n FROM pairs GROUP BY ALL")
def similarity_bands(spark, sf_dir):
    """DU11: bands of similar pairs."""
    from corpusloom.functions.features import SIMILARITY_CUTS, band

    pairs = pairs_of(spark, sf_dir, 0.5).select(band(F.col("jaccard"), SIMILARITY_CUTS, ("<=0.50", "0.50-0.70", "0.70-0.80", "0.80-0.90", ">0.90")).alias("band"))
    return pairs.groupBy("band").agg(F.count("*").alias("n"))


@query("fuzzy_cap", f"WITH RECURSIVE {SQL_LINKS}, k AS (SELECT d.doc_id, row_number() OVER (PARTITION BY coalesce(CAST(component AS VARCHAR), 'single:' || CAST(doc_id AS VARCHAR)) ORDER BY sha256('7|cap|' || CAST(doc_id AS VARCHAR))) AS r FROM documents d LEFT JOIN c ON d.doc_id = c.node) SELECT doc_id FROM k WHERE r = 1")
def fuzzy_cap(spark, sf_dir):
    """DU7, DU7a: one row of each component, first in hash order."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return U.fuzzy_cap(docs, "doc_id", links_of(spark, sf_dir), 1, [X.key_joined(7, "cap", F.col("doc_id"))]).select("doc_id")


@query("staged_caps", f"WITH RECURSIVE {SQL_VIEWS}, {SQL_LINKS}, x AS (SELECT *, row_number() OVER (PARTITION BY canonical_sha256 ORDER BY doc_id) AS i FROM families), y AS (SELECT *, row_number() OVER (PARTITION BY family_signature ORDER BY doc_id) AS j FROM x WHERE i = 1), z AS (SELECT y.*, row_number() OVER (PARTITION BY coalesce(CAST(component AS VARCHAR), 'single:' || CAST(doc_id AS VARCHAR)) ORDER BY doc_id) AS k FROM y LEFT JOIN c ON y.doc_id = c.node WHERE j = 1) SELECT 'start' AS stage, lang, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'exact', lang, count(*) FROM y GROUP BY ALL UNION ALL SELECT 'family', lang, count(*) FROM z GROUP BY ALL UNION ALL SELECT 'fuzzy', lang, count(*) FROM z WHERE k = 1 GROUP BY ALL")
def staged_caps(spark, sf_dir):
    """SA8: caps by canonical text, by family signature and by fuzzy component one after the other, with the rows that each stage leaves per frame."""
    docs = features(spark, sf_dir, U.signatures).select("doc_id", "lang", "canonical_sha256", "family_signature")
    exact = A.cap_groups(docs, "canonical_sha256", 1, ["doc_id"])
    family = A.cap_groups(exact, "family_signature", 1, ["doc_id"])
    fuzzy = U.fuzzy_cap(family, "doc_id", links_of(spark, sf_dir), 1, ["doc_id"])
    out = None
    for stage, rows in (("start", docs), ("exact", exact), ("family", family), ("fuzzy", fuzzy)):
        n = rows.groupBy("lang").agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "lang", "n")
        out = n if out is None else out.union(n)
    return out


EDGES = "('c1', 1, 2, 0.95), ('c1', 2, 3, 0.9), ('c1', 1, 3, 0.85), ('c1', 3, 4, 0.7), ('c1', 4, 5, 0.8), ('c1', 5, 6, 0.8), ('c1', 4, 6, 0.75), ('c2', 7, 8, 0.9)"


def _edges(spark):
    return spark.sql(f"SELECT component, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(jaccard AS DOUBLE) AS jaccard FROM VALUES {EDGES} AS t(component, a, b, jaccard)")


@query("bridge_edges", "SELECT * FROM (VALUES ('c1', CAST(3 AS BIGINT), CAST(4 AS BIGINT)), ('c2', CAST(7 AS BIGINT), CAST(8 AS BIGINT))) AS t(component, a, b)")
def bridge_edges(spark, sf_dir):
    """DU8, WN11: links that alone hold a component together."""
    return U.bridge_edges(_edges(spark))


@query("cluster_packs", f"WITH e AS (SELECT * FROM (VALUES {EDGES}) AS t(component, a, b, jaccard)) SELECT component, count(DISTINCT node) AS n_nodes, any_value(n_edges) AS n_edges, any_value(lo) AS min_jaccard, any_value(md) AS median_jaccard, CAST(1 AS BIGINT) AS n_bridges, count(DISTINCT node) >= 5 AS review_required FROM (SELECT component, unnest([a, b]) AS node FROM e) JOIN (SELECT component, count(*) AS n_edges, CAST(min(jaccard) AS DOUBLE) AS lo, CAST(median(jaccard) AS DOUBLE) AS md FROM e GROUP BY component) USING (component) GROUP BY component")
def cluster_packs(spark, sf_dir):
    """DU9: a review pack per component."""
    return U.cluster_pack(_edges(spark), U.bridge_edges(_edges(spark)), required=5)


SQL_EDGES = f"e AS (SELECT component, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, jaccard FROM (VALUES {EDGES}) AS t(component, a, b, jaccard))"


@query("cluster_evidence", f"""WITH {SQL_EDGES}, x AS (SELECT component, unnest([a, b]) AS node FROM e), g AS (SELECT component, node, count(*) AS degree FROM x GROUP BY ALL),
b AS (SELECT 'c1' AS component, CAST(3 AS BIGINT) AS a, CAST(4 AS BIGINT) AS b UNION ALL SELECT 'c2', 7, 8), n AS (SELECT component, node, degree, node * 10 AS length, node % 3 AS kind FROM g),
r AS (SELECT component, node, 'high_degree' AS reason FROM g QUALIFY row_number() OVER (PARTITION BY component ORDER BY degree DESC, node) <= 3
UNION ALL SELECT component, unnest([a, b]), 'weak_edge_endpoint_' || k FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY jaccard, a, b) AS k FROM e) WHERE k <= 4
UNION ALL SELECT component, unnest([a, b]), 'reviewed_bridge_endpoint' FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY a, b) AS k FROM b) WHERE k <= 4
UNION ALL SELECT component, node, 'shortest_text' FROM n QUALIFY row_number() OVER (PARTITION BY component ORDER BY length, node) = 1
UNION ALL SELECT component, node, 'longest_text' FROM n QUALIFY row_number() OVER (PARTITION BY component ORDER BY length DESC, node DESC) = 1
UNION ALL SELECT component, node, 'metadata_diversity' FROM (SELECT component, kind, min(node) AS node FROM n GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY component ORDER BY node) <= 6),
d AS (SELECT component, node, list_sort(list_distinct(list(reason))) AS rs FROM r GROUP BY ALL)
SELECT component, node, CAST(row_number() OVER (PARTITION BY component ORDER BY len(list_filter(rs, lambda y: starts_with(y, 'weak_edge'))) = 0, NOT list_contains(rs, 'high_degree'), degree DESC, node) AS INTEGER) AS evidence_rank, degree, array_to_string(rs, '|') AS reasons FROM d JOIN g USING (component, node)""")
def cluster_evidence(spark, sf_dir):
    """DU10: nodes worth reading and why."""
    nodes = spark.range(1, 9).select(F.col("id").alias("node"), (F.col("id") * 10).alias("length"), (F.col("id") % 3).alias("kind"))
    return U.cluster_evidence(_edges(spark), U.bridge_edges(_edges(spark)), nodes)


@query("family_pairs", f"WITH {SQL_VIEWS}, m AS (SELECT family_signature, doc_id AS a, lead(doc_id) OVER w AS b, row_number() OVER w AS r, count(*) OVER (PARTITION BY family_signature) AS n FROM families WHERE eligible WINDOW w AS (PARTITION BY family_signature ORDER BY doc_id)), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, family_signature) AS k FROM m WHERE r = 1 AND n > 1), o AS (SELECT *, row_number() OVER (ORDER BY sha256('7|family|' || family_signature)) AS j FROM p WHERE k > 10) SELECT family_signature, a, b, n, 'census' AS selection FROM p WHERE k <= 10 UNION ALL SELECT family_signature, a, b, n, 'sample' FROM o WHERE j <= 15")
def family_pairs(spark, sf_dir):
    """DU12, CF7, JN7, WN6: pairs of the largest families and of a hash-ordered sample of others."""
    return U.family_pairs(features(spark, sf_dir, U.signatures).filter("family_eligible"), "family_signature", "doc_id", 10, 15, 7)


@query("benchmark_overlap", """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark),
g AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i+7], 'string_agg', ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
q AS (SELECT DISTINCT item_id, list_aggregate(w[i:i+7], 'string_agg', ' ') AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8))
SELECT item_id, doc_id, count(*) AS shared FROM g JOIN q USING (h) GROUP BY ALL""")
def benchmark_overlap(spark, sf_dir):
    """SE5, TX13: documents that share eight words in a row with a benchmark item."""

    def grams(name, key):
        rows = table(spark, sf_dir, name).select(key, F.inline(F.array(F.struct(X.words(F.col("text")).alias("w")))))
        return rows.select(key, F.explode(X.hashed_ngrams(F.col("w"), 8)).alias("h"))

    # the items' hashes are written first: the engine then knows their size and broadcasts them only if they are few
    return grams("documents", "doc_id").join(saved(grams("benchmark", "item_id")), "h").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


@query("reviewed_caps", "SELECT * FROM (VALUES (CAST(1 AS BIGINT)), (CAST(3 AS BIGINT))) AS t(id)")
def reviewed_caps(spark, sf_dir):
    """DU7 after review: a bridge that wasn't confirmed splits its component, so two rows stay at a cap of one."""
    rows = spark.range(1, 4).select("id")
    pairs = spark.createDataFrame([(1, 2, "yes"), (2, 3, "yes")], "a bigint, b bigint, same string")
    edges = U.reviewed_edges(pairs, spark.createDataFrame([], "component bigint, valid string"), spark.createDataFrame([(2, 3, "no")], "a bigint, b bigint, same string"))
    return U.fuzzy_cap(rows, "id", edges, 1, ["id"], largest=50).select("id")
