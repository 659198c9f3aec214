import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import features as V
from corpusloom.functions import text as X


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_canonical_masks(spark):
    row = one(spark, c=X.canonical(F.lit("a\r\n\r\n\r\n\r\nPaid {$ 1,200.50} on XX/XX/2024  to XXXX ")), a=X.amounts(F.lit("{$5.00} and {$ 7}")))
    assert row.c == "a\n\nPaid [AMOUNT] on [DATE] to [REDACTED]" and row.a == ["{$5.00}", "{$ 7}"]


def test_views(spark):
    row = one(spark, m=X.matching(F.lit("Hello, 42 XX [DATE]!")), lex=X.lexical(F.lit("a [DATE] b  [AMOUNT]")), r=X.residue(F.lit("One 2 three")), f=X.fold_apostrophes(F.lit("can’t")), v=X.redaction_view(F.lit("XXXX XXXX paid .")))
    assert row.m == "hello [number] xx [date]" and row.lex == "a b" and row.r == "one three" and row.f == "can't" and row.v == "[REDACTED] paid."


def test_normal_forms(spark):
    df = spark.createDataFrame([("Ｉ can’t",), (None,), ("plain",)], "t string")
    assert [r[0] for r in df.select(X.fold_apostrophes(X.normalizer("NFKC")("t"))).collect()] == ["I can't", None, "plain"]


def test_byte_literals(spark):
    df = spark.createDataFrame([(1, "b'caf\\xc3\\xa9'"), (2, "b'\\xff'"), (3, "b'\\xzz'"), (4, "text"), (5, "b'a' + 'b'"), (6, None), (7, "b'\n'")], "k int, t string")
    got = {r.k: (r.u.text, r.u.status) for r in df.select("k", X.unwrapper()("t").alias("u")).collect()}
    assert got[1] == ("café", "unwrapped_utf8") and got[2][1] == "failed_utf8" and got[3][1] == "failed_invalid_escape" and got[4] == ("text", "not_applicable")
    assert got[5][1] == "failed_value" and got[6] == (None, "not_applicable") and got[7][1] == "failed_syntax"
    assert df.filter("k = 2").select(X.unwrapper(True)("t")["text"]).first()[0] == "�"


def test_core_section(spark):
    row = one(spark, a=X.core_section(F.lit("Key: x\nComplaint narrative: it\nbroke ")), b=X.core_section(F.lit(" whole ")))
    assert (row.a.text, row.a.found, row.b.text, row.b.found) == ("it\nbroke", True, "whole", False)


def test_family_signature(spark):
    long = "the bank did not answer my letter about the account at all in {} weeks"
    df = spark.createDataFrame([(1, long.format(3)), (2, long.format(12)), (3, "short"), (4, "short")], "k int, t string")
    got = {r.k: r.f for r in df.select("k", X.family_signature(F.col("t"), F.col("k")).alias("f")).collect()}
    assert got[1] == got[2] and got[1].eligible and got[3].signature == "ineligible:3" != got[4].signature


def test_keys_do_not_collide(spark):
    row = one(spark, a=X.key_json(7, "n", F.lit('x"|y'), F.lit("z")), b=X.key_json(7, "n", F.lit('x"'), F.lit("y|z")), c=X.key_joined(7, "n", F.lit("x|y")), d=X.key_joined(7, "n", F.lit("x"), F.lit("y")))
    assert row.a != row.b and row.c == row.d
    import hashlib
    import json

    assert row.a == hashlib.sha256(json.dumps([7, "n", 'x"|y', "z"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


SPANS = st.lists(st.tuples(st.integers(0, 20), st.integers(1, 6)), max_size=6)


@settings(max_examples=25, deadline=None)
@given(SPANS)
def test_span_replacement(spark, spans):
    text = "abcdefghijklmnopqrstuvwxyz"
    spans = [(s, s + n) for s, n in spans]
    merged = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    want, at = "", 0
    for s, e in merged:
        want += text[at:s] + "[PII_CANDIDATE]"
        at = e
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start: int, end: int>>")
    assert df.select(X.replace_spans(F.col("t"), X.merge_spans(F.col("s")))).first()[0] == want + text[at:]


def test_chunks_keep_the_text(spark):
    text = "é" * 50_000 + "end"
    parts = one(spark, c=X.chunks(F.lit(text)), e=X.chunks(F.lit("")))
    assert "".join(parts.c) == text and [len(p) for p in parts.c] == [30_000, 20_003] and parts.e == [""]


def test_sheet_safe(spark):
    row = one(spark, a=X.sheet_safe(F.lit("=1+1")), b=X.sheet_safe(F.lit("a\x01b")), c=X.sheet_safe(F.lit("fine")))
    assert (row.a, row.b, row.c) == ("'=1+1", "a?b", "fine")


def test_contexts(spark):
    df = spark.createDataFrame([("one two three two",), (None,)], "t string")
    got = [r[0] for r in df.select(X.keyword_contexts("two", 4)("t")).collect()]
    assert [(k.start, k.left, k.keyword, k.right) for k in got[0]] == [(4, "one ", "two", " thr"), (14, "ree ", "two", "")] and got[1] == []


def test_ngrams(spark):
    row = one(spark, a=X.ngrams(F.split(F.lit("a b c d"), " "), 3), b=X.ngrams(F.split(F.lit("a b"), " "), 3), h=F.size(X.hashed_ngrams(F.split(F.lit("a b a b a b"), " "), 2)))
    assert row.a == ["a b c", "b c d"] and row.b == [] and row.h == 2


def test_mattr(spark):
    tokens = lambda xs: F.array(*[F.lit(x) for x in xs])
    row = one(spark, short=V.mattr(tokens("a" * 24)), same=V.mattr(tokens(["a"] * 25)), distinct=V.mattr(tokens([str(k) for k in range(26)])))
    assert row.short is None and row.same == pytest.approx(1 / 25) and row.distinct == pytest.approx(1)


def test_redaction_measures(spark):
    row = one(spark, **V.redaction_measures(F.lit(3), F.lit(4), F.lit(1)), **{f"z_{k}": v for k, v in V.redaction_measures(F.lit(0), F.lit(0), F.lit(0)).items()})
    assert row.redactions_per_lexical_word == 3 and row.redaction_placeholder_proportion == 0.75 and row.all_placeholder_proportion == 0.8 and row.z_redaction_placeholder_proportion == 0


def test_detectors(spark):
    text = F.lit("I think it was NOT authorised!! I mean, it was charged by them. VISA XXXX SHOUT")
    row = one(spark, **{k: v for k, v in V.detect(text, F.lit(10), V.EXTENDED).items() if not k.endswith("words")}, caps=V.capitals_emphasis(text), upper=V.uppercase_ratio(F.lit("AB cd [DATE]")))
    assert row.hedging and row.negation and row.self_repair and row.authorization and not row.agentless_passive and row.caps == 2 and row.upper == 0.5


def test_pii_types(spark):
    got = one(spark, a=V.matched_names(F.lit("a@b.example, 555-123-4567, 123-45-6789, account number 1234567, 1.2.3.4"), V.PII), b=V.matched_names(F.lit("1234567890123"), V.PII_RELEASE), c=V.missing_names(F.lit("1.2.3.4"), V.PII))
    assert got.a == ["email", "phone", "ssn", "account_context", "ipv4"] and got.b == ["long_digit_run"] and "email" in got.c and "ipv4" not in got.c


def test_bands(spark):
    values = spark.createDataFrame([(x,) for x in (0.5, 0.51, 0.9, 0.95, None)], "x double")
    names = ("a", "b", "c", "d", "e")
    assert [r[0] for r in values.select(V.band(F.col("x"), V.SIMILARITY_CUTS, names)).collect()] == ["a", "b", "d", "e", None]
    sizes = spark.createDataFrame([(x,) for x in (1, 2, 5, 10, 25, 99, 100)], "n int")
    assert [r[0] for r in sizes.select(V.family_size_band(F.col("n"))).collect()] == ["1", "2", "3-5", "6-10", "11-25", "26-99", "100+"]


def test_grounding(spark):
    row = one(spark, e=F.struct(*[c.alias(n) for n, c in V.grounding(F.lit("")).items()]), g=F.struct(*[c.alias(n) for n, c in V.grounding(F.lit("[DATE] two words")).items()]))
    assert row.e.placeholder_fraction == 1.0 and (row.g.tokens, row.g.placeholders) == (2, 1)


def test_token_set_ratio(spark):
    df = spark.createDataFrame([("a b c", "c b a a"), ("a b", "a b c d"), ("x", "y"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(V.token_set_ratio()("a", "b")).collect()] == [100.0, 100.0, 0.0, 0.0]


def test_patterns_by_name(spark):
    got = one(spark, a=V.first_name(F.lit("b then a"), {"x": "a", "y": "b"}, "none"), b=V.first_name(F.lit("c"), {"x": "a"}, "none"), s=X.numbers(F.lit("3, 1,000 and 3")), q=V.quality_score(F.lit(3), F.lit(4), F.lit(0.0), F.lit(1.0)))
    assert (got.a, got.b, got.s, got.q) == ("x", "none", ["1,000", "3"], 1.0)


def test_positions_and_contexts_of_many_matches(spark):
    import re

    texts = ["", "nothing", "ab1 cd22 é333 x", " ".join(f"w{k}" for k in range(3000)), "1", "1 2" * 70]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.inline(F.array(F.struct(F.col("t").alias("t")))))
    for r in df.select("t", X.contexts(F.col("t"), "[0-9]+", 5).alias("c")).collect():
        want = [(m.start(), m.end(), r.t[max(0, m.start() - 5) : m.start()], m[0], r.t[m.end() : m.end() + 5]) for m in re.finditer("[0-9]+", r.t)]
        assert [tuple(c) for c in r.c] == want
