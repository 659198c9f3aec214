"""License scans in built-in functions alone: TF-IDF cosine to templates, then inheritance along paths.

Sentences and lines that speak of a license are a document's headers, wrapped ones put together. Each becomes a sparse vector of
word weights and is compared by cosine with the statements by which licenses are named; the document's whole text is compared with
whole license texts. A document's own license is its best match over the bound. A licence file is one that is named so and has a
match, or whose whole text is a license's; a document that merely quotes a statement is none. A document without a license takes that
of the licence file in its nearest ancestor directory, found by joining the directories' ancestors with the directories of licence files.

The template table is fixed, so joins with its words broadcast a bounded table. Null text counts as empty and has no license of
its own; a null path lies in no directory and inherits nothing. Ties go to the better cosine, then the license's name. Long texts
are compared whole. Repeated rows repeat, null ids pass through, an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import once, read, stage_table

#: The statements by which licenses are named, several to a license, and the titles of long licenses.
STATEMENTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "Copyright. All rights reserved."),
)
#: Identifiers that a line SPDX-License-Identifier names, and the license each stands for.
IDENTIFIERS = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-3.0": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-2.0": "GPL-2.0",
    "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause",
    "ISC": "ISC", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
}
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole texts of short licenses.
TEXTS = (
    ("MIT", """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)
#: (license, whether it is a whole text, text) of all templates.
TEMPLATES = [(name, False, text) for name, text in STATEMENTS]
TEMPLATES += [(name, False, f"SPDX-License-Identifier: {i}") for i, name in IDENTIFIERS.items()]
TEMPLATES += [(name, True, text) for name, text in TEXTS]
#: What makes a sentence a header.
CUE = r"(?i)licen[cs]e|spdx|copyright|public domain|redistribution and use|all rights reserved|permission is hereby granted"
#: Names of licence files, without directory.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-][A-Za-z0-9._-]*)?$"
MIN_COSINE = 0.7
#: What comments put before their lines.
LEADER = r"(^|\n)[\x20\x09]*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--+|-->)[\x20\x09]*"
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def terms_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def template_weights() -> tuple[dict[str, float], list[tuple[int, bool, str, str, float]], float]:
    """idf by word; (template, whole, license, word, weight) with weights of length one; and the idf of any other word."""
    counted = [Counter(terms_of(text)) for _, _, text in TEMPLATES]
    n = len(counted)
    df = Counter(w for c in counted for w in c)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    rows = []
    for k, ((name, whole, _), c) in enumerate(zip(TEMPLATES, counted, strict=True)):
        norm = math.sqrt(sum((f * idf[w]) ** 2 for w, f in c.items()))
        rows += [(k, whole, name, w, f * idf[w] / norm) for w, f in sorted(c.items())]
    return idf, rows, math.log(1 + n) + 1


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?;])[\x20\x09]+", "$1\n"), "\n")


def headers(text: Column) -> Column:
    """The different sentences and lines that speak of a license, with those that are wrapped over several lines, of a comment perhaps, put together."""
    bare = F.regexp_replace(text, LEADER, "$1")
    unwrapped = F.regexp_replace(F.regexp_replace(bare, r"\n(?:[\x20\x09\r]*\n)+", "\x01"), r"[\x20\x09\r]*\n[\x20\x09]*", " ")
    parts = F.array_distinct(F.concat(sentences(bare), sentences(F.replace(unwrapped, F.lit("\x01"), F.lit("\n")))))
    return F.when(text.rlike(CUE), F.filter(parts, lambda p: p.rlike(CUE))).otherwise(F.array().cast("array<string>"))


def directory(path: Column) -> Column:
    """The path without its last name; "" is the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(df: DataFrame, id_col: str, text_col: str, path: Column, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, path, own_license, cosine, n_headers, is_file, inherited_from, license, basis); basis: header, file, inherited or none."""
    spark = df.sparkSession
    idf, weights, other = template_weights()
    templates = spark.createDataFrame(weights, "template int, whole boolean, name string, term string, weight double")
    words = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), path.alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    named = F.coalesce(F.regexp_extract(F.col("path"), r"[^/]*$", 0).rlike(FILE_NAMES), F.lit(False))
    part = lambda whole, body: F.struct(F.lit(whole).alias("whole"), body.alias("body"))
    whole_text = F.when(named | F.col("text").rlike(CUE), F.array(part(True, F.col("text")))).otherwise(F.array().cast("array<struct<whole: boolean, body: string>>"))
    found = F.concat(F.transform(headers(F.col("text")), lambda h: part(False, h)), whole_text)
    rows = once(rows, parts=found).select("id", "path", named.alias("named"), "parts").withColumn("row_no", F.monotonically_increasing_id())
    rows = stage_table(rows, "licenses")
    each = rows.filter(F.size("parts") > 0).select("row_no", F.posexplode("parts").alias("part", "p"))
    counts = each.select("row_no", "part", "p.whole", F.explode(F.regexp_extract_all(F.lower("p.body"), F.lit(_WORD), F.lit(0))).alias("term"))
    counts = counts.groupBy("row_no", "part", "whole", "term").count().join(F.broadcast(words), "term", "left").withColumn("w", F.col("count") * F.coalesce("idf", F.lit(other)))
    norms = counts.groupBy("row_no", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = counts.join(F.broadcast(templates), ["term", "whole"]).groupBy("row_no", "part", "whole", "template", "name").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["row_no", "part"]).withColumn("cosine", F.round(F.least(F.lit(1.0), F.col("dot") / F.col("norm")), 9)).filter(F.col("cosine") >= min_cosine)
    first = lambda name="name": F.min(F.struct((-F.col("cosine")).alias("c"), F.col(name).alias("name"))).alias("best")
    best = scored.groupBy("row_no", "part", "whole").agg(first())
    best = best.select("row_no", "whole", F.col("best.name").alias("name"), (-F.col("best.c")).alias("cosine"))
    best = stage_table(best.groupBy("row_no").agg(F.count(F.when(~F.col("whole"), 1)).alias("n_headers"), F.max("whole").alias("whole"), first()), "matches")
    own = rows.select("row_no", "id", "path", "named").join(best, "row_no", "left")
    own = own.select(
        "id",
        "path",
        directory(F.col("path")).alias("dir"),
        F.col("best.name").alias("own_license"),
        (-F.col("best.c")).alias("cosine"),
        F.coalesce("n_headers", F.lit(0)).cast("bigint").alias("n_headers"),
        F.coalesce(F.col("best").isNotNull() & (F.col("named") | F.col("whole")), F.lit(False)).alias("is_file"),
    )
    own = stage_table(own, "own")
    # one license a directory: the best match among its licence files
    given = own.filter(F.col("is_file") & F.col("dir").isNotNull()).groupBy("dir").agg(first("own_license"))
    given = stage_table(given.select(F.col("dir").alias("ancestor"), F.col("best.name").alias("given")), "given")
    # each directory with its ancestors and itself, and the nearest of them that has a license
    dirs = own.filter(F.col("dir").isNotNull()).groupBy("dir").agg(F.lit(1).alias("one"))
    names = F.filter(F.split("dir", "/"), lambda x: x != "")
    rooted = F.when(F.startswith("dir", F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    climbs = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(rooted, F.array_join(F.slice(names, 1, k), "/"))))).alias("depth", "ancestor"))
    near = climbs.join(given, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "given")).alias("near"))
    near = stage_table(near.select("dir", F.col("near.ancestor").alias("inherited_from"), F.col("near.given").alias("given")), "nearest")
    out = own.join(near, "dir", "left")
    has = F.col("own_license").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        "own_license",
        "cosine",
        "n_headers",
        "is_file",
        F.when(~has, F.col("inherited_from")).alias("inherited_from"),
        F.coalesce("own_license", "given").alias("license"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("basis"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each a file named by its id in the directory of its language within that of its source."""
    docs = read(spark, sf_dir, "documents")
    return scan(docs, "doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def _sql() -> str:
    """The same rows by other means: words of all parts, weights in a table of values, ancestors from split paths."""
    idf, weights, other = template_weights()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parted = lambda x: f"string_split(regexp_replace({x}, '([.!?;])[\\x20\\x09]+', '\\1' || chr(10), 'g'), chr(10))"
    leader = LEADER.replace("'", "''")
    return f"""
WITH words(term, idf) AS (VALUES {", ".join(f"({quote(w)}, {x!r}::DOUBLE)" for w, x in sorted(idf.items()))}),
templates(template, whole, name, term, weight) AS (VALUES {", ".join(f"({k}, {str(whole).lower()}, {quote(n)}, {quote(w)}, {x!r}::DOUBLE)" for k, whole, n, w, x in weights)}),
d AS (SELECT row_number() OVER () AS row_no, doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, regexp_replace(t, '{leader}', '\\1', 'g') AS bare FROM d WHERE regexp_matches(t, '{CUE}')),
u AS (SELECT *, regexp_replace(regexp_replace(bare, '\\n(?:[\\x20\\x09\\r]*\\n)+', chr(1), 'g'), '[\\x20\\x09\\r]*\\n[\\x20\\x09]*', ' ', 'g') AS joined FROM c),
p AS (SELECT row_no, false AS whole, unnest(list_distinct(list_concat({parted("bare")}, {parted("replace(joined, chr(1), chr(10))")}))) AS body FROM u UNION ALL SELECT row_no, true, t FROM c),
q AS (SELECT row_number() OVER () AS part, * FROM p WHERE whole OR regexp_matches(body, '{CUE}')),
w AS (SELECT part, row_no, whole, term, count(*) AS n FROM (SELECT part, row_no, whole, unnest(regexp_extract_all(lower(body), '{_WORD}')) AS term FROM q) GROUP BY ALL),
x AS (SELECT w.*, n * coalesce(idf, {other!r}::DOUBLE) AS v FROM w LEFT JOIN words USING (term)),
l AS (SELECT part, sqrt(sum(v * v)) AS norm FROM x GROUP BY part),
s AS (SELECT part, x.row_no, x.whole, name, round(least(1.0, sum(v * weight) / any_value(norm)), 9) AS cosine FROM x JOIN templates USING (term, whole) JOIN l USING (part) GROUP BY part, x.row_no, x.whole, template, name),
m AS (SELECT row_no, count(DISTINCT part) FILTER (NOT whole) AS n_headers, bool_or(whole) AS is_file, max(cosine) AS cosine, arg_min(name, (-cosine, name)) AS own_license FROM s WHERE cosine >= {MIN_COSINE} GROUP BY row_no),
o AS (SELECT d.row_no, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, cosine, coalesce(n_headers, 0) AS n_headers, coalesce(is_file, false) AS is_file FROM d LEFT JOIN m USING (row_no)),
g AS (SELECT dir AS ancestor, arg_min(own_license, (-cosine, own_license)) AS given FROM o WHERE is_file GROUP BY dir),
a AS (SELECT dir, unnest(range(0, len(f) + 1)) AS depth, f FROM (SELECT DISTINCT dir, list_filter(string_split(dir, '/'), lambda y: y <> '') AS f FROM o)),
b AS (SELECT a.dir, arg_max(ancestor, depth) AS inherited_from, arg_max(given, depth) AS given FROM a JOIN g ON g.ancestor = array_to_string(f[1:depth], '/') GROUP BY a.dir)
SELECT doc_id, path, own_license, cosine, n_headers, is_file, CASE WHEN own_license IS NULL THEN inherited_from END AS inherited_from, coalesce(own_license, given) AS license,
  CASE WHEN own_license IS NOT NULL AND is_file THEN 'file' WHEN own_license IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis FROM o LEFT JOIN b USING (dir)
"""


SQL = _sql()
