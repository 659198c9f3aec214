"""Queries over generic relational operators and the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import relational as J
from corpusloom.plans.catalog import query, table
from corpusloom.streaming import events as E


@query("monthly_counts", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def monthly_counts(spark, sf_dir):
    """AG3."""
    rows = table(spark, sf_dir, "events").filter("ts is not null and event_type is not null")
    return rows.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


@query("group_counts", "SELECT lang, source, count(*) AS n, median(n_chars) AS median_chars FROM documents GROUP BY ALL")
def group_counts(spark, sf_dir):
    """AG1, AG2, AG28."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.median("n_chars").alias("median_chars"))


@query("pivot_counts", "SELECT lang, count(*) FILTER (doc_id % 3 = 0) AS a, count(*) FILTER (doc_id % 3 = 1) AS b, count(*) FILTER (doc_id % 3 = 2) AS c FROM documents GROUP BY lang")
def pivot_counts(spark, sf_dir):
    """AG12: a pivot over declared values, missing cells 0."""
    kind = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("kind", kind).groupBy("lang").pivot("kind", ["a", "b", "c"]).count().fillna(0)


@query("melted_flags", "SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN lang = 'en' THEN 'english' END]) AS flag FROM documents) WHERE flag IS NOT NULL GROUP BY flag")
def melted_flags(spark, sf_dir):
    """AG13: flags turned long, true ones counted."""
    flags = table(spark, sf_dir, "documents").select((F.col("n_chars") < 500).alias("short"), (F.col("lang") == "en").alias("english"))
    return flags.unpivot([], ["short", "english"], "flag", "v").filter("v").groupBy("flag").agg(F.count("*").alias("n"))


@query("exploded_sets", "SELECT part, count(*) AS n FROM (SELECT unnest(string_split(lang || '|' || source, '|')) AS part FROM documents) GROUP BY part")
def exploded_sets(spark, sf_dir):
    """AG15: values joined by bars, counted one by one."""
    joined = F.concat_ws("|", "lang", "source")
    return table(spark, sf_dir, "documents").select(F.explode(F.split(joined, r"\|")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("value_shares", "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY lang")
def value_shares(spark, sf_dir):
    """AG14."""
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


@query("running_totals", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def running_totals(spark, sf_dir):
    """WN7."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("group_sizes", "SELECT doc_id, count(*) OVER (PARTITION BY lang, source) AS group_size FROM documents")
def group_sizes(spark, sf_dir):
    """WN1."""
    return J.group_size(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"]).select("doc_id", "group_size")


@query("first_orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_orders(spark, sf_dir):
    """WN3: the first row of each key."""
    return J.top_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("second_orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 2")
def second_orders(spark, sf_dir):
    """WN6."""
    return J.nth_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("order_pairs", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT a.o_custkey, a.n AS group_size, a.o_orderkey AS o_orderkey_a, b.o_orderkey AS o_orderkey_b FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.k = 1 AND b.k = 2")
def order_pairs(spark, sf_dir):
    """JN7."""
    return J.first_pair(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey"])


@query("numbered_rows", "SELECT format('REG-{:05d}', row_number() OVER (ORDER BY n_chars DESC, doc_id)) AS record_id, doc_id FROM documents")
def numbered_rows(spark, sf_dir):
    """WN10, SO1: sequential ids in a full order, without a window over all rows."""
    return J.sequential_ids(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "REG", [F.desc("n_chars"), "doc_id"], 5).select("record_id", "doc_id")


@query("numbered_orders", "SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number, CAST(round(sum(o_custkey) OVER (ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS customers FROM orders")
def numbered_orders(spark, sf_dir):
    """WN7, WN10, SO1 with all further columns: row numbers and a running sum in a full order."""
    order = ["o_totalprice", "o_orderkey"]
    return J.running_sum(J.number_rows(table(spark, sf_dir, "orders"), order), order, "o_custkey", "customers")


@query("null_safe_anti", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN lang END AS a, source AS b FROM documents) d WHERE NOT EXISTS (SELECT 1 FROM (SELECT CASE WHEN doc_id % 4 > 0 THEN lang END AS a, source AS b FROM documents WHERE doc_id % 20 = 0) x WHERE d.a IS NOT DISTINCT FROM x.a AND d.b IS NOT DISTINCT FROM x.b)")
def null_safe_anti(spark, sf_dir):
    """JN6."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("a"), F.col("source").alias("b"))
    return J.anti_null_safe(docs, docs.filter("doc_id % 20 = 0").select("a", "b"), ["a", "b"]).select("doc_id")


@query("semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark, sf_dir):
    """JN4."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("checked_join", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def checked_join(spark, sf_dir):
    """JN2, JN9: a join whose lookup side is checked for repeated keys."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    checked = J.join_one_to_one(region, region.select("r_regionkey"), ["r_regionkey"])
    return nation.join(checked, nation.n_regionkey == checked.r_regionkey).select("n_nationkey", "n_name", "r_name")


@query("set_sizes", "SELECT count(*) FILTER (l.doc_id IS NULL) AS only_a, CAST(0 AS BIGINT) AS only_b, count(*) FILTER (l.doc_id IS NOT NULL) AS both FROM documents d LEFT JOIN labels l USING (doc_id)")
def set_sizes(spark, sf_dir):
    """SE3."""
    return J.set_report(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@query("revenue_by_nation", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark, sf_dir):
    """JN1 over four tables, column-pruned."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")).groupBy("l_orderkey").agg(F.sum("r").alias("r"), F.count("*").alias("c"))
    joined = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("c").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Windowed counts, the same operator that runs on streams."""
    return E.windowed_counts(table(spark, sf_dir, "events")).withColumns({"total": F.round("total", 6), "window_start": F.col("window_start").cast("timestamp_ntz")})


@query("event_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    """Sessions with a gap, the same operator that runs on streams."""
    found = E.sessions(table(spark, sf_dir, "events"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
