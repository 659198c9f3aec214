import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import licenses, pii, quality, secrets

LETTERS = st.text(alphabet="ab@.+-() 0123456789%_x", max_size=60)


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_pii_base_spans_of_any_text(text):
    found = pii.find_spans(text)
    for kind, spans in brute.pii(text).items():
        assert [(s, e) for _, s, e in found[kind]] == spans


def test_pii_rows(spark):
    rows = pii.pii_spans(brute.documents(spark)).collect()
    texts = [r.text for r in brute.documents(spark).collect()]
    assert len(rows) == len(texts)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.spans])
    for r in brute.documents(spark).collect():
        base = [(k, s, e) for k, v in brute.pii(r.text).items() for s, e in v]
        assert any([x for x in spans if x[0] in pii.BASE_KINDS] == base for spans in by_id[r.doc_id])
    kinds = {k for spans in by_id[14] for k, _, _ in spans[0:0] or spans for k in [k]}
    assert {"url", "account"} <= kinds
    assert pii.pii_spans(brute.empty(spark)).count() == 0


def test_secrets_rows(spark):
    docs = brute.documents(spark)
    rows = secrets.scan(docs, carry=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.secrets if s.kind in secrets.BASE] == brute.secrets(r.text)
    assert secrets.scan(brute.empty(spark)).count() == 0


def test_secret_owners_and_redaction(spark):
    live, copied = "Zx81kLq29PwT77", "Common9876Key12"
    rows = [(1, f"token={live}!", "a"), (2, f"é token={copied}", "a"), (3, f"token={copied}", "b"), (4, f"token={copied}", "c"), (5, "token=aaaaaaaa", None)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    clean = secrets.redact(F.col("text"), F.filter("secrets", lambda s: s["live"]))
    got = {r.doc_id: (r.secrets[0].n_owners, r.secrets[0].live, r.clean) for r in found.withColumn("clean", clean).collect()}
    assert got[1] == (1, True, "[SECRET]!")
    assert [got[k][:2] for k in (2, 3, 4)] == [(3, False)] * 3 and got[2][2] == f"é token={copied}"
    assert got[5][:2] == (1, False)


def test_quality_rows(spark):
    docs = brute.documents(spark)
    rows = quality.judge(docs, carry=["doc_id", "text", "kept"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute.quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert quality.judge(brute.empty(spark)).count() == 0


def test_quality_verdicts(spark):
    prose = "The bridge was built in spring and the town held a fair beside it for a week, with music and food. " * 1
    rows = [(1, prose + "\nIt was a fine time for all who came to see the river and the new road."), (2, "Home | About | Shop | Help\n" * 12 + "A short line here."), (3, "### *** %%% $$$ &&& " * 12), (4, prose + "\nAll rights reserved.")]
    got = {r.doc_id: (r.kept, r.clean_text) for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4)] == [True, False, False, True]
    assert "reserved" not in got[4][1]


@pytest.mark.parametrize("seed", range(3))
def test_repeated_windows(spark, seed):
    random.seed(seed)
    rows = [(k, " ".join(random.choice("abc") for _ in range(random.randint(0, 80)))) for k in range(60)]
    for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        assert r.n_repeat_words == brute.quality(rows[r.doc_id][1])[4]


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x.py", "print(1)"), (4, "a/b/c/d/e.py", "x"), (5, "z/q.py", "# Released under the MIT License.\nmany lines of code() that are no header at all"),
        (3, "a/b/c/COPYING", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
        (6, None, None), (7, "zz/y", "nothing"), (7, "zz/y", "nothing"), (8, "z/licensed", "an unlicensed friend. I licensed it"),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id int, path string, text string"), "doc_id", "text", F.col("path")).collect()
    got = {r.doc_id: (r.license, r.basis, r.inherited_from) for r in found}
    assert len(found) == len(rows)
    assert got[1] == ("Apache-2.0", "file", None) and got[2] == ("Apache-2.0", "inherited", "a") and got[4] == ("GPL-3.0", "inherited", "a/b/c")
    assert got[5] == ("MIT", "header", None) and got[3] == ("GPL-3.0", "file", None) and got[6][1] == got[7][1] == got[8][1] == "none"
    assert licenses.scan(brute.empty(spark), "doc_id", "text", F.col("source")).count() == 0
    assert licenses.scan(brute.documents(spark), "doc_id", "text", F.col("source")).count() == brute.documents(spark).count()


def test_secrets_of_a_text_with_many_hits(spark):
    import time

    text = " ".join(f"token=abcdefgh{k:06d} é" for k in range(6000))
    rows = spark.createDataFrame([(1, text, "a")], "doc_id int, text string, source string").withColumn("secrets", F.lit("mine"))
    began = time.time()
    found = secrets.scan(rows)
    assert found.columns == ["doc_id", "text", "source", "secrets"]
    assert [(s.kind, s.start, s.end) for s in found.first().secrets] == brute.secrets(text)
    assert time.time() - began < 30


MIT = licenses.TEXTS[0][1].removeprefix("MIT License. ")
GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() {}"""
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works."""
APACHE_FILE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.
"""


def test_real_license_texts_and_headers(spark):
    rows = [
        (1, "a/LICENSE", f"MIT License\n\nCopyright (c) 2020 A Person\n\n{MIT}", "MIT", "file"),
        (2, "a/x/y.py", "code", "MIT", "inherited"),
        (3, "b/y.py", "# SPDX-License-Identifier: GPL-3.0-or-later\ncode", "GPL-3.0", "header"),
        (4, "c/z.c", GPL_HEADER, "GPL-3.0", "header"),
        (5, "d/w.py", '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n', "Apache-2.0", "header"),
        (6, "e/q", "SPDX-License-Identifier: Zlib", None, "none"),
        (7, "f/COPYING", GPL_FILE, "GPL-3.0", "file"),
        (8, "g/LICENSE", APACHE_FILE, "Apache-2.0", "file"),
        (9, "i/s.c", "// SPDX-License-Identifier: MIT\n", "MIT", "header"),
        (10, "j/LICENSE.txt", "Copyright (c) 2011, The Foo Authors\nAll rights reserved.\n\n" + licenses.TEXTS[3][1].replace(". ", ".\n"), "BSD-3-Clause", "file"),
        (11, "k/text", f"Copyright (c) 2020 A Person\n\n{MIT}", "MIT", "file"),
        (12, "k/other", "nothing", "MIT", "inherited"),
        (13, "l/quotes", "Released under the MIT License.", "MIT", "header"),
        (14, "l/other", "nothing", None, "none"),
        (15, "m/isc", licenses.TEXTS[1][1], "ISC", "file"),
    ]
    found = licenses.scan(spark.createDataFrame([r[:3] for r in rows], "doc_id int, path string, text string"), "doc_id", "text", F.col("path")).collect()
    assert {(r.doc_id, r.license, r.basis) for r in found} == {(k, name, basis) for k, _, _, name, basis in rows}


def test_license_cosines_by_hand(spark):
    import math
    import re
    from collections import Counter

    words = lambda t: Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower()))
    counted = [words(t) for _, _, t in licenses.TEMPLATES]
    df = Counter(w for c in counted for w in c)
    idf = lambda w: math.log((1 + len(counted)) / (1 + df[w])) + 1

    def cosine(a, b):
        va, vb = ({w: n * idf(w) for w, n in x.items()} for x in (a, b))
        return sum(va[w] * vb.get(w, 0) for w in va) / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))

    def best(text):
        one = words(text)
        scored = [(-round(min(1.0, cosine(one, c)), 9), name) for (name, whole, _), c in zip(licenses.TEMPLATES, counted, strict=True) if not whole]
        c, name = min(scored)
        return (name, -c) if -c >= licenses.MIN_COSINE else (None, None)

    texts = [t for _, t in licenses.STATEMENTS if "; " not in t and ", Version" not in t and "http" not in t]
    texts += ["This file is licensed under the MIT license of old", "Licensed under a license", "license license license", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the BSD License."]
    texts += ["GNU General Public License"]  # equal cosines to several versions' titles are told apart by name
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in licenses.scan(rows, "doc_id", "text", F.lit(None).cast("string")).collect():
        parts = [p for p in re.split(r"(?<=[.!?;])[ \t]+", texts[r.doc_id]) if re.search(licenses.CUE, p)]
        named = [best(p) for p in parts]
        want = min((x for x in named if x[0]), key=lambda x: (-x[1], x[0]), default=(None, None))
        assert (r.own_license, r.cosine) == (want[0], pytest.approx(want[1], abs=2e-9) if want[0] else None), texts[r.doc_id]
