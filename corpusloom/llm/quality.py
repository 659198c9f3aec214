"""Quality rules, line first, in built-in functions alone.

Each line that holds a word is judged by itself: too many symbols for its text, a navigation bar, a boilerplate phrase, no
letters, or a fragment without closing punctuation. Lines that fail are removed; a document that loses too much of its
text is rejected, as is one that fails the rules on words and repeated windows.

Null text counts as empty: no words, no lines, rejected. Every row is judged on its own, so repeated rows repeat, null
ids pass through and an empty table gives an empty result. Texts are judged whole, however long; a line equal to an earlier one
is judged like it. Other columns are ignored unless asked for; of those, one named like a column that is made is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import WS, once, read

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: The symbols that the contract counts.
SYMBOLS = "#*$%&|<>"
#: A line fails if more than this share of its characters but white space are symbols.
MAX_SYMBOL_SHARE = 0.1
#: A line with as many bars as this, or more, is navigation.
NAVIGATION_BARS = 3
#: A line of fewer words fails unless it closes with punctuation.
FRAGMENT_WORDS = 3
#: A document that loses more than this share of its characters in lines is rejected.
MAX_LOST_SHARE = 0.5
#: What marks a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here",
    "skip to content",
    "powered by wordpress",
)

MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text")
_SPACES = r"[\x20\x09-\x0D]"


def without(text: Column, characters: str) -> Column:
    """The text without these characters; a search that finds none costs little, which a table of characters does not."""
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WS))


def holds_boilerplate(low: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found |= F.contains(low, F.lit(phrase))
    return found


def line_fails(line: Column, suspect: Column) -> Column:
    """Whether a line that holds a word is to be removed. suspect: whether its document holds a boilerplate phrase at all. Costly tests stand behind cheap ones."""
    body = F.length(without(line, WS))
    symbols = F.length(line) - F.length(without(line, SYMBOLS))
    bars = F.length(line) - F.length(without(line, "|"))
    word, gap = r"[^\x20\x09-\x0D]+", f"{_SPACES}+"
    enough_words = f"^{_SPACES}*{gap.join([word] * FRAGMENT_WORDS)}"
    return (
        (line.rlike(f"[{SYMBOLS}]") & ((symbols > MAX_SYMBOL_SHARE * body) | (bars >= NAVIGATION_BARS)))
        | ~line.rlike(r"\p{L}")
        | (~line.rlike(enough_words) & ~line.rlike(rf"[\p{{P}}]{_SPACES}*$"))
        | (suspect & holds_boilerplate(F.lower(line)))
    )


def judge(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, clean_text."""
    carry = [c for c in (df.columns if carry is None else carry) if c not in MADE]
    own = [F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(carry)]
    rows = df.select(*own, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    bare = trimmed(F.col("text"))
    rows = once(
        rows,
        words=F.transform(F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{_SPACES}+")), lambda w: F.xxhash64(w)),
        lines=F.filter(F.split("text", "\n"), lambda x: trimmed(x) != ""),
        suspect=F.exists(F.array(F.lower("text")), holds_boilerplate),
    )
    # hashes of 2, 4 and then 8 neighbouring words, each from two of the step before
    joined = lambda c, gap: F.transform(c, lambda h, i: F.xxhash64(h, F.get(c, i + gap)))
    rows = once(rows, pairs=joined("words", 1), good=F.filter("lines", lambda x: ~line_fails(x, F.col("suspect"))))
    rows = once(rows, quads=joined("pairs", 2))
    rows = once(rows, windows=F.slice(joined("quads", 4), F.lit(1), F.greatest(F.lit(0), F.size("words") - (WINDOW - 1))))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(again, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))
    rows = once(rows, ordered=ordered)
    same = lambda e, k: F.coalesce(F.get("ordered", k)["h"] == e["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("ordered", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n")),
    )["n"]
    chars = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    rows = rows.select(
        *[f"c_{k}" for k in range(len(carry))],
        F.size("words").cast("bigint").alias("n_words"),
        F.length(without(F.col("text"), WS)).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        chars("lines").alias("line_chars"),
        (chars("lines") - chars("good")).alias("lost_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_chars") <= MAX_LOST_SHARE * F.col("line_chars")))
    return rows.select(*[F.col(f"c_{k}").alias(c) for k, c in enumerate(carry)], *MADE)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), carry=["doc_id"]).drop("clean_text")


_WORD_SQL = "[^\\x20\\x09-\\x0D]+"
_PHRASES_SQL = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '{_WORD_SQL}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD_SQL}')) AS ls FROM d
), g AS (
  SELECT row_no, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS win FROM (SELECT row_no, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), s AS (
  SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, win) AS n FROM g) WHERE n > 1
), r AS (
  SELECT row_no, CAST(sum(c) AS BIGINT) AS n FROM (SELECT row_no, least(8, i - lag(i, 1, i - 8) OVER (PARTITION BY row_no ORDER BY i)) AS c FROM s) GROUP BY row_no
), l AS (
  SELECT row_no, length(x) AS n, length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS plain, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) AS body, length(replace(x, '|', '')) AS unbarred, x
  FROM (SELECT row_no, unnest(ls) AS x FROM w)
), f AS (
  SELECT row_no, sum(n) AS line_chars, coalesce(sum(n) FILTER (
    n - plain > {MAX_SYMBOL_SHARE}::DOUBLE * body OR n - unbarred >= {NAVIGATION_BARS} OR NOT regexp_matches(x, '\\p{{L}}') OR {_PHRASES_SQL}
    OR (len(regexp_extract_all(x, '{_WORD_SQL}')) < {FRAGMENT_WORDS} AND NOT regexp_matches(x, '\\p{{P}}[\\x20\\x09-\\x0D]*$'))), 0) AS lost FROM l GROUP BY row_no
), a AS (
  SELECT doc_id, len(ws) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(f.lost, 0) AS BIGINT) AS lost_chars, coalesce(f.line_chars, 0) AS line_chars
  FROM w LEFT JOIN r USING (row_no) LEFT JOIN f USING (row_no)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, NOT base_failed AND lost_chars <= {MAX_LOST_SHARE}::DOUBLE * line_chars AS kept FROM b
"""
