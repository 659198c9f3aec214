"""Text views, keys and spans as column expressions. Nothing is changed in place: each view is a new column."""

from __future__ import annotations

import ast
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of masked amounts, masked dates, redactions, the section header and the placeholders.
AMOUNT = r"\{\s*\$\s*[\d,.]+\s*\}"
MASKED_DATE = r"(?i)X{2}/X{2}/(?:X{2,8}|\d{2,4}|year>)"
REDACTION = r"\bX{2,}\b"
CORE_SECTION = r"(?is)\bcomplaint narrative\s*:\s*(.+)"
PLACEHOLDER = r"\[(?:REDACTED|DATE|AMOUNT)\]"
WORD = r"\b[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)?\b"
SENTENCE = r"[^.!?\n]+(?:[.!?]+|$)"
SHINGLE_WORD = r"[a-z0-9']+"
# What is replaced in a release, in this order.
RELEASE_PII = (
    ("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("PHONE", r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)"),
    ("SSN", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    ("ACCOUNT", r"(?i)\b(?:account|acct|card)\s*(?:number|no\.?|#)\s*\d{6,}\b"),
    ("IPV4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
)


def sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def strip(text: Column) -> Column:
    return sub(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(sub(text, r"\s+", " "))


def normalizer(form: str):
    """A function from a column to its Unicode normal form; the engine has none built in."""

    @F.pandas_udf(T.StringType())
    def normalize(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normalize


def unwrapper(lenient: bool = False):
    """A function from a column to struct(text, status): texts that are written as byte literals are turned into what they spell.

    status: not_applicable, unwrapped_utf8, or the kind of failure; a failed text stays as it is. lenient: invalid bytes become replacement signs.
    """
    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("status", T.StringType())])

    def one(text: str | None) -> tuple[str | None, str]:
        bare = (text or "").strip()
        if len(bare) < 3 or bare[0] != "b" or bare[1] not in "'\"" or bare[-1] != bare[1]:
            return text, "not_applicable"
        try:
            value = ast.literal_eval(bare)
        except SyntaxError as e:
            return text, "failed_invalid_escape" if "escape" in str(e) else "failed_syntax"
        except ValueError:
            return text, "failed_value"
        if not isinstance(value, bytes):
            return text, "failed_not_bytes"
        try:
            return value.decode("utf-8", "replace" if lenient else "strict"), "unwrapped_utf8"
        except UnicodeDecodeError:
            return text, "failed_utf8"

    @F.pandas_udf(result)
    def unwrap(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in text], columns=["text", "status"])

    return unwrap


def core_section(text: Column) -> Column:
    """struct(text, found): what follows the section header, or all of it."""
    found = text.rlike(CORE_SECTION)
    return F.struct(strip(F.when(found, F.regexp_extract(text, CORE_SECTION, 1)).otherwise(text)).alias("text"), F.coalesce(found, F.lit(False)).alias("found"))


def canonical(text: Column) -> Column:
    """Line ends, amounts, dates, redactions and blanks in one form; the text is taken to be in normal form already (see normalizer)."""
    out = sub(sub(text, "\r\n", "\n"), "\r", "\n")
    out = sub(sub(sub(out, AMOUNT, "[AMOUNT]"), MASKED_DATE, "[DATE]"), REDACTION, "[REDACTED]")
    return strip(sub(sub(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def amounts(text: Column) -> Column:
    """The amounts that canonical masks, as written."""
    return F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0))


def redaction_view(text: Column) -> Column:
    """The older canonical view: runs of redactions merged, no space before punctuation."""
    out = sub(sub(text, AMOUNT, "[AMOUNT]"), REDACTION, "[REDACTED]")
    out = sub(out, r"(?:\[REDACTED\][\s/]*){2,}", "[REDACTED] ")
    return squeeze(sub(out, r"\s+([.,;:!?])", "$1"))


def matching(text: Column) -> Column:
    """Lower-case letters, brackets and single spaces; digits become [number]. Placeholders stay as bracketed words."""
    return squeeze(sub(sub(F.lower(text), r"[0-9]+", " [number] "), r"[^a-z\[\] ]+", " "))


def lexical(text: Column) -> Column:
    return squeeze(sub(text, PLACEHOLDER, " "))


def fold_apostrophes(text: Column) -> Column:
    return F.translate(text, "’‘ʼ`´", "'''''")


def residue(text: Column) -> Column:
    return squeeze(sub(sub(matching(text), r"\[placeholder\]", " "), r"\[number\]", " "))


def family_signature(text: Column, key: Column, min_chars: int = 40, min_tokens: int = 8) -> Column:
    """struct(signature, eligible): texts with one residue share a signature; short ones have one of their own."""
    rest = residue(text)
    eligible = (F.length(rest) >= min_chars) & (F.size(F.split(rest, " ")) >= min_tokens)
    return F.struct(F.when(eligible, F.sha2(rest, 256)).otherwise(F.concat(F.lit("ineligible:"), key.cast("string"))).alias("signature"), F.coalesce(eligible, F.lit(False)).alias("eligible"))


def family_signature_prefix(text: Column, chars: int = 400) -> Column:
    """The oldest signature: letters and digits of the first characters, no eligibility."""
    return F.sha1(F.substring(squeeze(sub(F.lower(text), r"[^a-z0-9 ]+", " ")), 1, chars))


def family_signature_sha1(text: Column) -> Column:
    return F.sha1(residue(text))


def key_joined(seed: int, namespace: str, *values: Column) -> Column:
    """A row's place in a seeded order: sha256 of seed|namespace|values."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(namespace), *[v.cast("string") for v in values]), 256)


def key_json(seed: int, namespace: str, *values: Column) -> Column:
    """The same from the JSON list [seed, namespace, values]; values that hold the separator can't collide."""
    listed = F.to_json(F.array(F.lit(namespace), *[v.cast("string") for v in values]))
    return F.sha2(F.concat(F.lit(f"[{seed},"), F.substring(listed, 2, 1 << 30)), 256)


def stable_id(prefix: str, digits: int, *values: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[v.cast("string") for v in values]), 256), 1, digits))


def redact(text: Column, patterns=RELEASE_PII) -> Column:
    for name, pattern in patterns:
        text = sub(text, pattern, f"[{name}]")
    return text


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column, pattern: str = SHINGLE_WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array, joined by spaces; name a column that is computed once."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def hashed_ngrams(tokens: Column, n: int) -> Column:
    """Distinct hashes of the n-grams: shorter to move than their texts."""
    return F.array_distinct(F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))))


def chunks(text: Column, size: int = 30_000) -> Column:
    """Parts of at most so many characters; together they are the text. An empty text has one empty part."""
    last = F.greatest(F.lit(0), F.length(text) - 1)
    return F.transform(F.sequence(F.lit(0), last, F.lit(size)), lambda at: F.substring(text, at + 1, F.lit(size)))


def sheet_safe(text: Column) -> Column:
    """Control characters escaped, and a quote before what a spreadsheet would run as a formula."""
    out = sub(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "?")
    return F.when(out.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), out)).otherwise(out)


def merge_spans(spans: Column) -> Column:
    """Spans (start, end) in order, those that overlap or touch as one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))
    empty = F.array().cast("array<struct<start: int, end: int>>")

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(ordered, empty, step)


def replace_spans(text: Column, merged: Column, mark: str = "[PII_CANDIDATE]") -> Column:
    """The text with each merged span replaced by the mark."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))

    return F.aggregate(merged, state, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def span_holds(text: Column, start: Column, end: Column, detected: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int")) == detected


def keyword_contexts(pattern: str, width: int = 80):
    """A function from a column to array<struct<start, end, left, keyword, right>> for every match."""
    import re

    compiled = re.compile(pattern)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("left", "keyword", "right")]]))

    @F.pandas_udf(kind)
    def contexts(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": m.start(), "end": m.end(), "left": t[max(0, m.start() - width) : m.start()], "keyword": m[0], "right": t[m.end() : m.end() + width]} for m in compiled.finditer(t or "")])

    return contexts


def label_lines(**values: Column) -> Column:
    """Lines `name: value`; line feeds within a value become spaces."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), sub(F.coalesce(v, F.lit("")), r"\s*\n\s*", " ")) for n, v in values.items()])


def safe_text(value: Column) -> Column:
    return squeeze(F.coalesce(value.cast("string"), F.lit("")))


#: Matches whose lengths are summed together; sums of whole blocks come first, so that work grows little faster than the matches.
BLOCK = 64


def match_starts(gaps: Column, hits: Column) -> Column:
    """Where each hit starts, from 0: the lengths of what stands before it. gaps: what stands between hits, the text's beginning first."""
    steps = F.transform(hits, lambda h, k: F.length(F.get(gaps, k)) + F.length(h))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(s, b * BLOCK + 1, F.lit(BLOCK)))))
    before = lambda sums: F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    bound = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    block = lambda k: F.floor(k / BLOCK).cast("int")

    def starts(s: Column, b: Column) -> Column:
        return F.transform(s, lambda _, k: F.get(b, block(k)) + add(F.slice(s, block(k) * BLOCK + 1, k % BLOCK)) + F.length(F.get(gaps, k)))

    return bound(steps, lambda s: bound(before(blocks(s)), lambda b: starts(s, b)))


def match_positions(text: Column, pattern: str) -> Column:
    """array<struct<start, match>> of all matches, from what stands between them; starts from 0. text: a column that is cheap to name again."""
    found = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))
    return F.get(F.transform(F.array(found), lambda f: F.transform(F.arrays_zip(match_starts(f["g"], f["h"]).alias("start"), f["h"].alias("match")), lambda z: F.struct(z["start"].alias("start"), z["match"].alias("match")))), 0)


def contexts(text: Column, pattern: str, width: int = 80) -> Column:
    """array<struct<start, end, left, keyword, right>> for every match, in built-in functions. text: a column that is cheap to name again."""

    def around(m: Column) -> Column:
        end = m["start"] + F.length(m["match"])
        left = F.substring(text, F.greatest(F.lit(0), m["start"] - width) + 1, F.least(F.lit(width), m["start"]))
        return F.struct(m["start"].alias("start"), end.alias("end"), left.alias("left"), m["match"].alias("keyword"), F.substring(text, end + 1, F.lit(width)).alias("right"))

    return F.transform(match_positions(text, pattern), around)
