"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import relational as J
from corpusloom.operators import rules as R
from corpusloom.sources import readers as I
from corpusloom.sources import writers as O
from corpusloom.plans.catalog import query, table


@query("source_inventory", "SELECT source, count(*) AS rows, count(DISTINCT doc_id) AS unique_ids, count(*) FILTER (trim(text) <> '') AS with_text, min(n_chars) AS first_date, max(n_chars) AS last_date FROM documents GROUP BY source")
def source_inventory(spark, sf_dir):
    """SC3, SC4: an inventory row per source."""
    return I.inventory(table(spark, sf_dir, "documents"), "source", "doc_id", "text", "n_chars")


@query("bulk_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate <= '1997-12-31' AND o_orderstatus IN ('F', 'O') AND contains(lower(o_orderpriority), 'high')")
def bulk_filter(spark, sf_dir):
    """SC8, PF1: dates, values, substring and non-blank in one predicate that the scan gets."""
    return I.bulk_filter(table(spark, sf_dir, "orders"), ("1996-01-01", "1997-12-31"), "o_orderdate", {"o_orderstatus": ["F", "O"]}, {"o_orderpriority": "HIGH"}, ["o_orderpriority"]).select("o_orderkey")


@query("decoded_labels", "SELECT doc_id, CASE quality WHEN 1 THEN 'good' END AS label FROM labels WHERE quality = 1")
def decoded_labels(spark, sf_dir):
    """SC10, JN9: label ids decoded for a subset."""
    names = spark.createDataFrame([(0, "poor"), (1, "good")], "quality int, label string")
    return I.decode_labels(table(spark, sf_dir, "labels"), "quality", names, ["good"]).select("doc_id", "label")


@query("repository_safe", "SELECT sha256(CAST(doc_id AS VARCHAR)) AS doc_id_sha256, lang, source, n_chars FROM documents")
def repository_safe(spark, sf_dir):
    """SK2, PF14: no texts, hashed ids."""
    return O.without_texts(table(spark, sf_dir, "documents"), "doc_id", ["text"]).select("doc_id_sha256", "lang", "source", "n_chars")


@query("release_view", "SELECT doc_id AS seed_id, lang AS product, 'v1' AS version, 2 AS turns FROM documents")
def release_view(spark, sf_dir):
    """PF13, PF14: renamed, constant and ordered columns."""
    return R.release_view(table(spark, sf_dir, "documents"), {"doc_id": "seed_id", "lang": "product"}, {"version": "v1", "turns": 2})


@query("override_marks", "SELECT doc_id, upper(lang) AS lang, lang AS lang_before_override FROM documents")
def override_marks(spark, sf_dir):
    """PF15."""
    return R.mark_override(table(spark, sf_dir, "documents").select("doc_id", "lang"), {"lang": F.upper("lang")})


@query("key_problems", "SELECT 'blank_keys' AS \"check\", CAST(0 AS BIGINT) AS n UNION ALL SELECT 'repeated_keys', count(*) - count(DISTINCT source) FROM documents")
def key_problems(spark, sf_dir):
    """PF16: blank and repeated keys."""
    return R.key_problems(table(spark, sf_dir, "documents"), "source")


@query("routed_counts", "SELECT CASE WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'review' ELSE 'validated' END AS route, count(*) AS n FROM labels GROUP BY ALL")
def routed_counts(spark, sf_dir):
    """SK7: what each sink would hold."""
    route = F.when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "review").otherwise("validated")
    return table(spark, sf_dir, "labels").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("clipped_values", "SELECT lang, round(avg(least(n_chars, p)), 6) AS mean FROM documents JOIN (SELECT lang, quantile_cont(n_chars, 0.99) AS p FROM documents GROUP BY lang) USING (lang) GROUP BY lang")
def clipped_values(spark, sf_dir):
    """SK10: the aggregate behind a plot, clipped at its 99th percentile."""
    docs = table(spark, sf_dir, "documents")
    tops = docs.groupBy("lang").agg(F.percentile("n_chars", F.lit(0.99)).alias("p"))
    return docs.join(tops, "lang").groupBy("lang").agg(F.round(F.avg(O.clipped(F.col("n_chars"), F.col("p"))), 6).alias("mean"))


@query("parsed_times", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def parsed_times(spark, sf_dir):
    """SC1's dates: mixed formats, the first that fits."""
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    when = I.parse_time(text, ["yyyy-MM-dd", "dd.MM.yyyy"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(when, "yyyy-MM").alias("month"))


@query("source_union", "WITH u AS (SELECT doc_id, 0 AS p, 'first' AS member FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, 'second' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, 'third' FROM documents WHERE doc_id % 5 = 0) SELECT doc_id, arg_min(member, p) AS owner, string_agg(member, '|' ORDER BY member) AS members FROM u GROUP BY doc_id")
def source_union(spark, sf_dir):
    """SE1, SE2, WN3, JN1, AG24: overlapping sources, one row a key by priority, with its memberships."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts = [docs.filter(f"doc_id % {n} = 0").select("doc_id", F.lit(k).alias("p"), F.lit(m).alias("member")) for k, (n, m) in enumerate(((2, "first"), (3, "second"), (5, "third")))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    members = whole.groupBy("doc_id").agg(F.concat_ws("|", F.array_sort(F.collect_set("member"))).alias("members"))
    return J.union_first(parts, ["doc_id"], ["p"]).select("doc_id", F.col("member").alias("owner")).join(members, "doc_id")
