"""Queries over files, normal forms, adapters and gates."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusloom.functions import features as V
from corpusloom.functions import text as X
from corpusloom.operators import governance as G
from corpusloom.operators.storage import new_folder
from corpusloom.operators.relational import same_rows
from corpusloom.plans.catalog import query, table
from corpusloom.sources import readers as I
from corpusloom.sources import writers as O


@query("file_round_trips", "SELECT format, (SELECT count(*) FROM nation) AS rows, true AS same FROM (VALUES ('csv'), ('tsv to csv'), ('json lines'), ('parquet once'), ('nested json')) AS t(format)")
def file_round_trips(spark, sf_dir):
    """SC1, SC2, SC5, SC6, SC7, SC12, SK1, SK3, SK4, SK5, SK6: a table written, read again and compared."""
    base = new_folder(spark)
    rows = table(spark, sf_dir, "nation").select(*[F.col(c).cast("string").alias(c) for c in ("n_nationkey", "n_name")])
    strings = "n_nationkey string, n_name string"
    O.write_csv(rows, f"{base}/a")
    O.write_csv(rows, f"{base}/b", sep="\t")
    O.write_json_lines(rows, f"{base}/c", sort_keys=True)
    first, again = O.write_once(rows, f"{base}/d"), O.write_once(rows, f"{base}/d")
    told = O.manifest(rows, f"{base}/d")
    rows.agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("entries")).write.option("compression", "gzip").json(f"{base}/e")
    back = {
        "csv": I.text_csv(spark, f"{base}/a", rows.columns),
        "tsv to csv": O.redelimit(I.text_csv(spark, f"{base}/b", rows.columns, sep="\t"), f"{base}/f"),
        "json lines": I.json_lines(spark, f"{base}/c", strings),
        "parquet once": spark.read.schema(rows.schema).parquet(f"{base}/d"),
        "nested json": I.nested_json(spark, f"{base}/e", f"entries array<struct<{strings.replace(' string', ': string')}>>").select(F.inline("entries")),
    }
    sound = first and not again and told["rows"] == rows.count() and all(len(f["sha256"]) == 64 for f in told["files"])
    return spark.createDataFrame([(n, d.count(), sound and same_rows(rows, d)) for n, d in back.items()], "format string, rows bigint, same boolean")


@query("registry_roles", "SELECT * FROM (VALUES ('banking intents', 'ok', 'intent'), ('banking intents', 'ok', 'split'), ('summaries', 'planned', 'summary')) AS t(name, status, role)")
def registry_roles(spark, sf_dir):
    """SC13: entries of a registry and their roles."""
    entries = {"entries": [{"name": "banking intents", "status": "ok", "roles": ["intent", "split"]}, {"name": "summaries", "status": "planned", "roles": ["summary"]}]}
    path = f"{new_folder(spark)}/registry"
    spark.createDataFrame([(json.dumps(entries, indent=1),)], "value string").write.text(path)
    return I.registry(spark, path)


@query("normal_forms", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'I can''t', 'I can''t'), (CAST(2 AS BIGINT), 'paid [AMOUNT] to [REDACTED].', 'paid {$5.00} to XXXX XXXX .'), (CAST(3 AS BIGINT), '', '')) AS t(id, redaction_view, safe)")
def normal_forms(spark, sf_dir):
    """TX6, TX7, TX10, TX11: compatibility form, straight apostrophes, merged redactions, safe text."""
    rows = spark.createDataFrame([(1, " Ｉ  can’t "), (2, "paid {$5.00} to XXXX XXXX ."), (3, None)], "id bigint, text string")
    normal = rows.select("id", X.fold_apostrophes(X.normalizer("NFKC")("text")).alias("t"))
    return normal.select("id", F.coalesce(X.redaction_view(F.col("t")), F.lit("")).alias("redaction_view"), X.safe_text(F.col("t")).alias("safe"))


@query("redaction_shares", "SELECT doc_id, CASE WHEN w = 0 THEN 0.0::DOUBLE ELSE r / w::DOUBLE END AS redactions_per_lexical_word, CASE WHEN r + w = 0 THEN 0.0::DOUBLE ELSE r / (r + w)::DOUBLE END AS redaction_placeholder_proportion, CASE WHEN p + w = 0 THEN 0.0::DOUBLE ELSE p / (p + w)::DOUBLE END AS all_placeholder_proportion FROM (SELECT doc_id, doc_id % 5 AS r, doc_id % 5 + doc_id % 3 AS p, doc_id % 7 AS w FROM documents)")
def redaction_shares(spark, sf_dir):
    """FE3."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in V.redaction_measures(k % 5, k % 5 + k % 3, k % 7).items()])


@query("external_scores", "SELECT item_id, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS score FROM benchmark")
def external_scores(spark, sf_dir):
    """FE23, FE24: where a parser's or sentiment model's score plugs in; here a plain count."""
    return table(spark, sf_dir, "benchmark").select("item_id", V.scorer(lambda t: t.count("e"))("text").alias("score"))


@query("gate_outcomes", "SELECT * FROM (VALUES ('rules', true), ('rules without a key', false), ('inputs', true), ('changed inputs', false), ('decision', true), ('unsigned decision', false)) AS t(gate, open)")
def gate_outcomes(spark, sf_dir):
    """GV1, GV2, GV7, SC9's cached inputs: gates over small records; each fails closed."""
    files = spark.createDataFrame([("x/a.csv", "12")], "path string, sha256 string")
    signed = {"privacy": {"decision": "approve", "reviewer": "r", "reviewed_utc": "2026-01-01T00:00:00Z"}}
    required = {"register": ["allowed"]}
    gates = {
        "rules": lambda: G.validate_rules({"register": {"allowed": ["x"]}}, required),
        "rules without a key": lambda: G.validate_rules({"register": {}}, required),
        "inputs": lambda: G.bound_inputs(files, {"a.csv": "12"}),
        "changed inputs": lambda: G.bound_inputs(files, {"a.csv": "13"}),
        "decision": lambda: G.decision_gate(signed, ["privacy"], (3, 3)),
        "unsigned decision": lambda: G.decision_gate({"privacy": {"decision": "approve"}}, ["privacy"]),
    }
    out = []
    for name, gate in gates.items():
        try:
            gate()
            out.append((name, True))
        except G.GateError:
            out.append((name, False))
    return spark.createDataFrame(out, "gate string, open boolean")
