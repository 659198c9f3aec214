"""Secret scans in built-in functions alone, with corpus-wide ownership frequency.

Spans come from splitting a text at a pattern's matches: the lengths of the pieces and of the matches give each match
its place. What each candidate hides is hashed, and hashes are counted over the whole corpus by distinct repositories and owners:
a value that many owners hold is a copied example, a varied value that few hold looks live and is theirs.

Null text counts as empty. Each row has its own result: repeated rows repeat, null ids pass through, a null owner or
repository is one of its own, an empty table gives an empty result. Whole texts are searched, long ones and those of many hits in
time near their length; hits at one place come in the order of the kinds. Columns are ignored unless carried; of those carried, one
named "secrets" is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import match_starts
from corpusloom.llm.common import once, read, stage_table

#: The contract's kinds, their patterns, and the group that holds the secret.
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1),
    "access": (r"AKIA[A-Z0-9]{12,}", 0),
    "hex": (r"[0-9a-f]{32,}", 0),
}
#: What the method adds.
EXTRA = {
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    "webtoken": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    "keyblock": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0),
}
KINDS = BASE | EXTRA
#: What a text must hold for a kind to be looked for at all.
HINTS = {"access": "AKIA", "forge": "gh", "webtoken": "eyJ", "keyblock": "PRIVATE KEY-----"}
MIN_ASSIGNED = 8
#: A value of more owners than this is a copied example.
MAX_OWNERS = 2
#: A value of fewer different characters doesn't look live.
MIN_VARIETY = 8
#: Words that mark a value as a sample.
SAMPLE_WORDS = ("example", "changeme", "placeholder", "dummy", "sample", "redacted", "xxxx")

SPAN = "array<struct<start: bigint, kind_no: int, kind: string, end: bigint, value: string>>"


def kind_spans(text: Column, number: int, kind: str) -> Column:
    """The kind's spans; text is a column that is cheap to name again."""
    pattern, group = KINDS[kind]
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def span(z: Column) -> Column:
        value = F.regexp_extract(z["hit"], pattern, group) if group else z["hit"]
        end = (z["start"] + F.length(z["hit"])).cast("bigint")
        return F.struct(z["start"].cast("bigint").alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))

    placed = lambda f: F.arrays_zip(match_starts(f["gaps"], f["hits"]).alias("start"), f["hits"].alias("hit"))
    spans = F.get(F.transform(F.array(found), lambda f: F.transform(placed(f), span)), 0)
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= MIN_ASSIGNED)
    there = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike(pattern)
    return F.when(there, spans).otherwise(F.array().cast(SPAN))


def looks_live(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= MIN_VARIETY
    return varied & ~F.lower(value).rlike("|".join(SAMPLE_WORDS))


def scan(df: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str | Column = "source", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) and secrets, an array of structs by start, then kind:

    start, kind_no, kind, end, value, n_owners, n_repos, live (varied, unmarked and of at most MAX_OWNERS owners).
    """
    carry = [c for c in (df.columns if carry is None else carry) if c != "secrets"]
    own = [F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(carry)]
    named = lambda c: F.coalesce((F.col(f"`{c}`") if isinstance(c, str) else c).cast("string"), F.lit("\0"))
    rows = df.select(*own, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), named(owner_col).alias("owner"), named(repo_col).alias("repo"))
    found = F.array_sort(F.concat(*[kind_spans(F.col("text"), n, kind) for n, kind in enumerate(KINDS)]))
    rows = once(rows, spans=found).drop("text").withColumn("row_no", F.monotonically_increasing_id())
    rows = stage_table(rows, "secrets")
    held = rows.filter(F.size("spans") > 0)
    each = held.select("row_no", "owner", "repo", F.explode("spans").alias("s"))
    each = each.withColumn("hash", F.sha2(F.col("s.value"), 256))
    # distinct owners and repositories of a hash, each counted after a partial sum
    counts = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repos"))
    counts = stage_table(counts, "owners")
    told = each.select("row_no", "hash", "s").join(counts, "hash")
    live = (F.col("n_owners") <= MAX_OWNERS) & looks_live(F.col("s.value"))
    told = told.select("row_no", F.struct("s.*", "n_owners", "n_repos", live.alias("live")).alias("s"))
    told = told.groupBy("row_no").agg(F.array_sort(F.collect_list("s")).alias("secrets"))
    kept = [f"c_{k}" for k in range(len(carry))]
    some = held.select("row_no", *kept).join(told, "row_no").select(*kept, "secrets")
    none = rows.filter(F.size("spans") == 0).select(*kept, F.array().cast(told.schema["secrets"].dataType).alias("secrets"))
    return some.union(none).select(*[F.col(f"c_{k}").alias(c) for k, c in enumerate(carry)], "secrets")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with the stretches that the spans cover, by start, each replaced by the mark."""
    state = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        out = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, rest))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by owner, their source; a source's documents of one language count as a repository."""
    found = scan(read(spark, sf_dir, "documents"), repo_col=F.concat_ws("/", "source", "lang"), carry=["doc_id"])
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    count = lambda name, test: F.size(F.filter("secrets", test)).cast("bigint").alias(name)
    of_kind = lambda k: lambda s: s["kind"] == k
    return found.select(
        "doc_id",
        *[count(f"n_{k}", of_kind(k)) for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count("n_live", lambda s: s["live"]),
        count("n_copied", lambda s: s["n_owners"] > MAX_OWNERS),
        F.coalesce(F.array_max(F.transform("secrets", lambda s: s["n_repos"])), F.lit(0)).cast("bigint").alias("most_repos"),
    )


def _spans_sql(number: int, kind: str) -> str:
    pattern, group = KINDS[kind]
    quoted = pattern.replace("'", "''")
    value = f"regexp_extract(hit, '{quoted}', 1)" if group else "hit"
    least = f" WHERE length(value) >= {MIN_ASSIGNED}" if kind == "assign" else ""
    return f"""SELECT row_no, {number} AS kind_no, '{kind}' AS kind, start, start + length(hit) AS "end", value FROM (SELECT row_no, hit, {value} AS value,
    CAST(list_sum([length(x) FOR x IN gaps[1:k]]) + coalesce(list_sum([length(x) FOR x IN hits[1:k - 1]]), 0) AS BIGINT) AS start
    FROM (SELECT row_no, gaps, hits, k, hits[k] AS hit FROM (SELECT row_no, gaps, hits, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT row_no, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS hits FROM d)))){least}"""


_LIST_SQL = "coalesce(string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, kind_no){}, '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner, concat_ws('/', source, lang) AS repo FROM documents),
s AS ({" UNION ALL ".join(_spans_sql(n, k) for n, k in enumerate(KINDS))}),
o AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT repo) AS n_repos FROM s JOIN d USING (row_no) GROUP BY value),
m AS (SELECT s.*, n_owners, n_repos, n_owners <= {MAX_OWNERS} AND len(list_distinct(string_split(value, ''))) >= {MIN_VARIETY} AND NOT regexp_matches(lower(value), '{"|".join(SAMPLE_WORDS)}') AS live FROM s JOIN o USING (value))
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
  sha256({_LIST_SQL.format(" FILTER (kind_no < " + str(len(BASE)) + ")")}) AS base_sha256, {_LIST_SQL.format("")} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (n_owners > {MAX_OWNERS}) AS n_copied, coalesce(max(n_repos), 0) AS most_repos
FROM d LEFT JOIN m USING (row_no) GROUP BY row_no, doc_id
"""
