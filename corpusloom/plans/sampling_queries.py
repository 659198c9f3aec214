"""Queries over allocations, draws, caps, quotas and their accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import key_joined, key_json
from corpusloom.operators import relational as J
from corpusloom.operators import sampling as A
from corpusloom.plans.catalog import query, sql_key, table

SEED = 20260713
SQL_ALLOCATION = """c AS (SELECT lang, source, count(*) AS available FROM documents GROUP BY ALL), i AS (SELECT *, available::DOUBLE / sum(available) OVER () * 100 AS ideal FROM c), f AS (SELECT *, floor(ideal) AS fl, ideal - floor(ideal) AS fractional_remainder FROM i), a AS (SELECT *, CAST(fl AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY fractional_remainder DESC, '["' || lang || '","' || source || '"]') <= 100 - sum(fl) OVER () THEN 1 ELSE 0 END AS allocated FROM f)"""


@query("allocation", f"WITH {SQL_ALLOCATION} SELECT lang, source, available, round(ideal, 9) AS ideal, CAST(allocated AS BIGINT) AS allocated, round(allocated / available, 9) AS inclusion_probability, round(CASE WHEN allocated > 0 THEN available / allocated END, 9) AS design_weight FROM a")
def allocation(spark, sf_dir):
    """SA1: largest-remainder allocation."""
    found = A.allocate(table(spark, sf_dir, "documents").select("lang", "source"), 100, ["lang", "source"])
    return found.select("lang", "source", "available", F.round("ideal", 9).alias("ideal"), "allocated", F.round("inclusion_probability", 9).alias("inclusion_probability"), F.round("design_weight", 9).alias("design_weight"))


@query("order_allocation", """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS available FROM orders GROUP BY ALL), i AS (SELECT *, available::DOUBLE / sum(available) OVER () * 500 AS ideal FROM c), f AS (SELECT *, floor(ideal) AS fl, ideal - floor(ideal) AS r FROM i) SELECT o_orderstatus, o_orderpriority, available, CAST(fl AS BIGINT) + CAST(row_number() OVER (ORDER BY r DESC, '["' || o_orderstatus || '","' || o_orderpriority || '"]') <= 500 - sum(fl) OVER () AS BIGINT) AS allocated FROM f""")
def order_allocation(spark, sf_dir):
    """SA1 over orders."""
    return A.allocate(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"), 500, ["o_orderstatus", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority", "available", "allocated")


SQL_CORE = f"""{SQL_ALLOCATION}, r AS (SELECT d.*, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY {sql_key(SEED, 'core', 'doc_id')}) AS k FROM documents d), core AS (SELECT r.doc_id, r.lang, r.source, allocated / available AS p FROM r JOIN a ON r.lang = a.lang AND r.source = a.source WHERE k <= allocated)"""


def core_of(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return A.stratified_sample(docs, 100, ["lang", "source"], "doc_id", SEED, "core")


@query("stratified_core", f"WITH {SQL_CORE} SELECT doc_id, lang, source, round(p, 9) AS inclusion_probability FROM core")
def stratified_core(spark, sf_dir):
    """SA2, SA3: a proportional draw in hash order."""
    return core_of(spark, sf_dir).select("doc_id", "lang", "source", F.round("inclusion_probability", 9).alias("inclusion_probability"))


@query("coverage_rows", f"WITH {SQL_CORE}, u AS (SELECT d.doc_id, d.lang, d.source, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY {sql_key(SEED, 'coverage', 'd.doc_id')}) AS k FROM documents d WHERE NOT EXISTS (SELECT 1 FROM core WHERE core.lang = d.lang AND core.source = d.source)) SELECT doc_id, lang, source, false AS prevalence_eligible FROM u WHERE k = 1")
def coverage_rows(spark, sf_dir):
    """SA5, JN6: a row of each stratum that the core lacks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return A.coverage_supplement(docs, core_of(spark, sf_dir), ["lang", "source"], "doc_id", SEED, "coverage")


@query("group_caps", "SELECT CAST(sum(n) AS BIGINT) AS before, CAST(sum(least(n, 1)) AS BIGINT) AS after, CAST(sum(n - least(n, 1)) AS BIGINT) AS removed, count(*) AS groups, count(*) FILTER (n > 1) AS groups_over_cap FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text))")
def group_caps(spark, sf_dir):
    """SA4: a group cap's account."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"))
    return A.cap_accounting(docs, "h", 1)


@query("capped_rows", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY {sql_key(SEED, 'cap', 'doc_id')}) AS k FROM documents) WHERE k = 1")
def capped_rows(spark, sf_dir):
    """WN2: the rows that a cap keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return A.cap_groups(docs, "h", 1, [key_json(SEED, "cap", F.col("doc_id"))]).select("doc_id")


@query("round_robin", f"WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_key(SEED, 'rr', 'doc_id')}) AS r, {sql_key(SEED, 'rr', 'doc_id')} AS h FROM documents) SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY r, lang, h) AS INTEGER) AS position FROM k ORDER BY r, lang, h LIMIT 60")
def round_robin(spark, sf_dir):
    """SA9, WN4: strata in turn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return J.round_robin(docs, ["lang"], key_json(SEED, "rr", F.col("doc_id")), 60).select("doc_id", "lang", "position")


@query("quota_account", "WITH s AS (SELECT doc_id, sha256(text) AS h, length(text) < 100 AS short, length(text) > 5000 AS long FROM documents) SELECT 'short' AS reason, CAST(5 AS BIGINT) AS requested, count(DISTINCT h) AS available, least(5, count(DISTINCT h)) AS selected FROM s WHERE short UNION ALL SELECT 'long', 20, count(DISTINCT h), least(20, count(DISTINCT h)) FROM s WHERE long")
def quota_account(spark, sf_dir):
    """SA6, SA7: quotas by reason, each without what earlier ones took."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.sha2("text", 256).alias("h"))
    quotas = [A.Quota("short", F.length("text") < 100, 5), A.Quota("long", F.length("text") > 5000, 20)]
    return A.quota_sets(docs, quotas, ["lang"], "doc_id", ["doc_id", "h"], SEED, "stress")[1]


@query("quota_rows")
def quota_rows(spark, sf_dir):
    """SA6, CF8: the rows that quotas drew; steps depend on each other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.sha2("text", 256).alias("h"))
    quotas = [A.Quota("short", F.length("text") < 100, 5), A.Quota("long", F.length("text") > 5000, 20), A.Quota("english", F.col("lang") == "en", 30)]
    return A.quota_sets(docs, quotas, ["lang"], "doc_id", ["doc_id", "h"], SEED, "stress")[0].select("doc_id", "lang", "quota_reason")


@query("refilled", f"WITH p AS (SELECT doc_id FROM documents WHERE length(text) < 60), r AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p) ORDER BY {sql_key(SEED, 'reserve', 'doc_id')} LIMIT greatest(0, 100 - (SELECT count(*) FROM p))) SELECT doc_id FROM p UNION ALL SELECT doc_id FROM r")
def refilled(spark, sf_dir):
    """SA12: a planned set filled from the reserve."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planned = docs.filter(F.length("text") < 60)
    return A.fill_shortfall(docs, planned, 100, "doc_id", [key_json(SEED, "reserve", F.col("doc_id"))]).select("doc_id")


@query("per_group_controls", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_key(SEED, 'control', 'doc_id')}) AS k FROM documents) WHERE k <= 8")
def per_group_controls(spark, sf_dir):
    """SA10: a fixed number of each group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return A.per_group(docs, ["lang"], 8, key_json(SEED, "control", F.col("doc_id"))).select("doc_id", "lang")


@query("equal_cells", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_key(SEED, 'cell', 'doc_id')}) AS k, {sql_key(SEED, 'cell', 'doc_id')} AS h FROM documents) ORDER BY k, lang, h LIMIT 42")
def equal_cells(spark, sf_dir):
    """SA11: equal shares of cells, leftovers filled in turn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return A.per_cell_equal(docs, ["lang"], 42, key_json(SEED, "cell", F.col("doc_id"))).select("doc_id", "lang")


@query("capped_pool", f"WITH o AS (SELECT doc_id, {sql_key(SEED, 'pool', 'doc_id')} AS h FROM documents WHERE NOT length(text) < 100) SELECT doc_id, 1.0::DOUBLE AS pool_weight FROM documents WHERE length(text) < 100 UNION ALL SELECT doc_id, (SELECT count(*) FROM o) / 200.0::DOUBLE FROM (SELECT doc_id FROM o ORDER BY h LIMIT 200)")
def capped_pool(spark, sf_dir):
    """SA13, DU4: protected rows stay, others are drawn and weighted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return A.capped_pool(docs, F.length("text") < 100, 200, key_json(SEED, "pool", F.col("doc_id"))).select("doc_id", "pool_weight")


@query("hash_order", f"SELECT doc_id FROM documents ORDER BY {sql_key(SEED, 'draw', 'doc_id')} LIMIT 50")
def hash_order(spark, sf_dir):
    """SO4, SO5: a draw in hash order in place of a shuffle by a random generator."""
    return A.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), 50, key_json(SEED, "draw", F.col("doc_id")))


@query("double_annotation", f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_key(SEED + 1, 'double', 'doc_id')}) AS k FROM documents), d AS (SELECT * FROM r WHERE k <= 12 ORDER BY k, lang, doc_id LIMIT 12) SELECT doc_id, lang, unnest(['A', 'B']) AS annotator FROM d")
def double_annotation(spark, sf_dir):
    """SA15: rows for two annotators."""
    return A.double_annotation(table(spark, sf_dir, "documents").select("doc_id", "lang"), 12, ["lang"], "doc_id", SEED)


@query("cell_targets", "SELECT * FROM (VALUES ('a', CAST(6 AS BIGINT)), ('b', CAST(3 AS BIGINT)), ('c', CAST(1 AS BIGINT))) AS t(cell, n)")
def cell_targets(spark, sf_dir):
    """SA14: reference shares with at least one each."""
    return spark.createDataFrame(sorted(A.share_allocation({"a": 0.6, "b": 0.35, "c": 0.01}, 10).items()), "cell string, n bigint")


@query("held_out_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src3')")
def held_out_rows(spark, sf_dir):
    """SA16, JN5: rows outside earlier ids and hashes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return J.anti_all(docs, {"doc_id": table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), "h": docs.filter("source = 'src3'").select("h")}).select("doc_id")


@query("cell_tops", "WITH a AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, row_number() OVER (PARTITION BY lang ORDER BY (source = 'src1') DESC, doc_id) AS j, source FROM documents) SELECT doc_id, lang FROM a WHERE k <= 5 OR (j <= 3 AND source = 'src1')")
def cell_tops(spark, sf_dir):
    """SO3: the best of each cell and the best with a flag, each once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    best = J.top_per_key(docs, ["lang"], [F.desc("n_chars"), "doc_id"], 5).drop("rank_in_group")
    flagged = J.top_per_key(docs.filter("source = 'src1'"), ["lang"], ["doc_id"], 3).drop("rank_in_group")
    return J.union_first([best, flagged], ["doc_id"], ["doc_id"]).select("doc_id", "lang")


@query("pii_sample_union", f"WITH r AS (SELECT doc_id FROM documents WHERE contains(text, '@') ORDER BY sha256('7|risk|' || CAST(doc_id AS VARCHAR)) LIMIT 20), c AS (SELECT doc_id FROM documents WHERE NOT contains(text, '@') ORDER BY sha256('7|control|' || CAST(doc_id AS VARCHAR)) LIMIT 30) SELECT doc_id, 'risk' AS selection FROM r UNION ALL SELECT doc_id, 'control' FROM c")
def pii_sample_union(spark, sf_dir):
    """CF2, CF3, SE2: risky rows and controls."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("@")).alias("risk"))
    parts = [A.hash_sample(docs.filter(t), n, key_joined(7, s, F.col("doc_id"))).select("doc_id", F.lit(s).alias("selection")) for t, n, s in ((F.col("risk"), 20, "risk"), (~F.col("risk"), 30, "control"))]
    return J.union_first(parts, ["doc_id"], ["selection"])


@query("pattern_audit", "WITH f AS (SELECT doc_id, lang, CAST(CAST(length(text) < 500 AS INTEGER) AS VARCHAR) || CAST(CAST(contains(text, '###') AS INTEGER) AS VARCHAR) AS bits FROM documents) SELECT doc_id, lang, bits FROM (SELECT *, row_number() OVER (PARTITION BY lang, bits ORDER BY sha256('7|bits|' || CAST(doc_id AS VARCHAR))) AS k FROM f) WHERE k <= 4")
def pattern_audit(spark, sf_dir):
    """CF4, CF5: a bit string of flags as stratum, a few rows of each."""
    bit = lambda c: c.cast("int").cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(bit(F.length("text") < 500), bit(F.contains("text", F.lit("###")))).alias("bits"))
    return A.per_group(docs, ["lang", "bits"], 4, key_joined(7, "bits", F.col("doc_id")))


@query("low_quality_draw", f"WITH l AS (SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 10), r AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l) ORDER BY {sql_key(SEED, 'audit', 'doc_id')} LIMIT 20) SELECT doc_id, 'lowest' AS kind FROM l UNION ALL SELECT doc_id, 'random' FROM r")
def low_quality_draw(spark, sf_dir):
    """CF9, CF10: the lowest and a hash-ordered rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    low = docs.orderBy("n_chars", "doc_id").limit(10)
    rest = A.hash_sample(docs.join(low.select("doc_id"), "doc_id", "left_anti"), 20, key_json(SEED, "audit", F.col("doc_id")))
    return low.select("doc_id", F.lit("lowest").alias("kind")).union(rest.select("doc_id", F.lit("random")))
