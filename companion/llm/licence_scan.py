"""Licence scan by canonical digests, in DataFrame functions only.

A text is made canonical: lower case, without copyright notices (lines that start with
"copyright", but not wrapped licence text such as "copyright holders"), with equivalent
spellings replaced, punctuation and blanks folded to single spaces.  Its SHA-256
is joined to the digests of known licences, made canonical by the same
expressions: the entire text of a document against entire licence texts.  The
same lookup over entire lines finds licence notices inside other documents.

Known texts are a parameter, a table (licence, scope, text) with scope ``text`` or
``notice``; the default is ``KNOWN`` and ``TITLED``, the same texts under their other
titles.

Scale: one pass over the texts; what is joined is a digest per document, and the
known side is a small table that Spark broadcasts below its measured threshold
and shuffles otherwise.  Lines are looked up in place, without a shuffle.

Defined cases: a null text is empty; empty canonical texts match nothing; licences
with equal digests are listed together; a line counts once per licence however
often it is repeated; repeated rows are kept; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from companion.llm.common import text_column

# Equivalent spellings, in order of replacement.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"),
    ("organisation", "organization"), ("whilst", "while"), ("favour", "favor"),
    ("https:", "http:"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"),
)
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
# Words after which such a line is licence text that a line break has brought
# there ("copyright notice and ...", "copyright holders be liable", "(c) you must").
AFTER_COPYRIGHT = (
    r"(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|disclaimers?|interests?|rights?|claims?|"
    r"treat(?:y|ies)|protection|infringement|ownership|management|information|and|or|is|in|to|of|for|are|"
    r"shall|that|as)\b")
AFTER_SIGN = r"(?:you|the|any|this|if|each|an?|all|to|in|for|that|such|it|must|shall)\b"
PROTECTED_LINE = (r"(?m)^[ \t*#/;-]*(?:copyright(?:[ \t]*$|[ \t,.;:]+" + AFTER_COPYRIGHT
                  + r")|\(c\)[ \t]+" + AFTER_SIGN + ")")
# The lines that are deleted: the first pattern without the second.
COPYRIGHT_NOTICE = (
    r"(?m)^[ \t*#/;-]*(?:copyright\b(?![ \t]*$)(?![ \t,.;:]+" + AFTER_COPYRIGHT
    + r")|\(c\)(?![ \t]+" + AFTER_SIGN + r")|©|all rights reserved)[^\n]*$")

# Licence texts and notices.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(""", provided that the above copyright notice and this permission notice
appear in all copies.""", ".")
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will
the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software.
3. This notice may not be removed or altered from any source distribution."""
KNOWN = (
    ("MIT", "text", MIT),
    ("MIT", "text", MIT.removeprefix("MIT License\n\n")),
    ("ISC", "text", ISC),
    ("ISC", "text", "ISC License\n\n" + ISC),
    ("0BSD", "text", ZERO_BSD),
    ("Zlib", "text", ZLIB),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
)
# Other usual titles of the entire texts.
TITLED = tuple(
    (licence, "text", f"{title}\n\n{text}") for licence, text, titles in (
        ("MIT", MIT.removeprefix("MIT License\n\n"),
         ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)")),
        ("ISC", ISC, ("The ISC License", "ISC License (ISC)", "The ISC License (ISC)")),
        ("0BSD", ZERO_BSD, ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD (0BSD)")),
        ("Zlib", ZLIB, ("zlib License", "The zlib License", "The zlib/libpng License")))
    for title in titles)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_NOTICE, "")
    for written, usual in SPELLINGS:
        out = F.replace(out, F.lit(written), F.lit(usual))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN + TITLED) -> DataFrame:
    """(digest, scope, licence), one row per digest and scope."""
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(
        list(known), "licence string, scope string, text string")
    rows = table.filter(canonical(F.col("text")) != "").groupBy(
        digest(F.col("text")).alias("digest"), "scope").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), "|").alias("licence"))
    return rows


def scan_licences(docs: DataFrame, known=KNOWN + TITLED) -> DataFrame:
    """One row per document: doc_id, licence (of the entire text, or null), n_notices,
    notices (licences of entire lines, sorted, comma-joined)."""
    table = known_digests(docs.sparkSession, known)
    whole = table.filter("scope = 'text'").select("digest", "licence")
    # the notices are a parameter of the scan: a short list, kept as a literal map
    lines = {r.digest: r.licence for r in table.filter("scope = 'notice'").collect()}
    rows = docs.select("doc_id", text_column(docs).alias("text"))
    notices = F.array().cast("array<string>")
    if lines:
        names = F.create_map(*[F.lit(x) for pair in lines.items() for x in pair])
        found = F.transform(F.split("text", "\n"), lambda line: F.try_element_at(names, digest(line)))
        notices = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    rows = rows.select("doc_id", digest(F.col("text")).alias("digest"), notices.alias("found"))
    return rows.join(whole, "digest", "left").select(
        "doc_id", "licence", F.size("found").cast("long").alias("n_notices"),
        F.array_join("found", ",").alias("notices"))
