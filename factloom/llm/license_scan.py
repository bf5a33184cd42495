"""Licence scan by canonical digests of entire texts, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import ASCII_LOWER, ASCII_UPPER, lower_ascii, table
from factloom.llm.license_texts import entire_texts

#: Known licences are broadcast up to this many (about 100 bytes each), else joined by a shuffle.
BROADCAST_LICENSES = 200_000
#: What may stand before a copyright line in a source file.
COMMENT = r"(?:(?:/?\*+!?|/{2,}|\#+|-{2,}|;+|%+|<!--|!)[ \t]*)?"
#: A mark, a year or a placeholder of one; or a holder, whose name has a capital where the word has but one, and is none of the words that licences put there.
DATED = r"(?:\(c\)|©|&copy;|[\[<{(]?(?:19|20)\d\d|[\[<{(]?(?:year|yyyy|xxxx)\b)"
HOLDER = r"(?-i:Copyright)[ \t:]+(?:by[ \t]+|the[ \t]+)?(?!(?:holders?|owners?|notices?|licen[sc]es?|laws?|statements?|interests?|rights?|treaty|and|or|in|of|act|permission)\b)(?-i:[A-Z])"
#: Lines that are dropped before a text is compared; wrapped licence wording that begins a line with the word copyright is kept.
COPYRIGHT_LINE = rf"(?mi)^[ \t]*{COMMENT}(?:(?:spdx-filecopyrighttext:|portions)[ \t]*)?(?:copyright[ \t:]*{DATED}|{HOLDER}|copyright[ \t]+by\b|\(c\)[ \t]*(?:copyright\b|{DATED})|©|spdx-filecopyrighttext:|all rights reserved)[^\n]*$"
#: The rule of the SQL: the texts at hand have no line that the two judge differently.
SQL_COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
# Spellings that count as the same, replaced in this order.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("&", " and "), ("https", "http"), ("organisation", "organization"), ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"), ("centre", "center"),
]
# Two entire licence texts and the one-line notices, (SPDX id, text). The SQL knows these alone.
LICENSES = [
    ("MIT", """MIT License

Copyright (c) year holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]


def _prepared(text: Column) -> Column:
    """Case, copyright lines and spellings; lines are kept."""
    out = lower_ascii(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, ""))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _words(prepared: Column) -> Column:
    return F.trim(F.regexp_replace(prepared, NOT_WORD, " "))


def canonical(text: Column) -> Column:
    """The text's words alone, in one spelling: what a digest is taken of."""
    return _words(_prepared(text))


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(known, license): digests of licenses(license, text), by default of LICENSES and all entire texts; of several ids for one text the first in order."""
    if licenses is None:
        licenses = LICENSES + entire_texts(LICENSES[0][1], LICENSES[1][1])
    if isinstance(licenses, list):
        licenses = spark.createDataFrame(licenses, "license string, text string")
    words = licenses.select("license", canonical(F.col("text")).alias("words")).where("words <> ''")
    return words.groupBy(F.sha2("words", 256).alias("known")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, licenses: list[tuple[str, str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, license, digest, n_notices, notices.

    A unit is an entire text: the document, and each of its lines by itself.
    Units are made canonical (case, punctuation, copyright lines and equivalent
    spellings do not count) and their digests are looked up among those of the
    known texts. license is what the whole document is, or null; notices are the
    distinct ids of its lines, sorted and comma-joined.

    The lookup is a join with a table that is counted first and broadcast only
    below BROADCAST_LICENSES. After it, a document is one small row and those of
    its matches. Null and empty texts, and texts of punctuation alone, have the
    digest of the empty text and no licence. Repeated rows and null ids each give
    a row; no known licences give none; other columns are ignored.
    """
    spark = docs.sparkSession
    known = known_digests(spark, licenses)
    near = F.broadcast(known) if known.count() <= BROADCAST_LICENSES else known
    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), _prepared(F.col(text_col)).alias("t"))
    units = read.select("rid", "doc_id", F.posexplode(F.concat(F.array("t"), F.split("t", "\n"))).alias("at", "unit"))
    hashed = units.select("rid", "doc_id", (F.col("at") == 0).alias("whole"), F.sha2(_words(F.col("unit")), 256).alias("digest"))
    met = hashed.join(near, F.col("digest") == F.col("known"), "left").where("whole or license is not null")
    whole = F.col("whole")
    found = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max(F.when(whole, F.col("license"))).alias("license"), F.max(F.when(whole, F.col("digest"))).alias("digest"),
        F.array_sort(F.collect_set(F.when(~whole, F.col("license")))).alias("ids"),
    )
    return found.select("doc_id", "license", "digest", F.size("ids").cast("long").alias("n_notices"), F.array_join("ids", ",").alias("notices"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_prepared(text: str) -> str:
    out = f"regexp_replace(translate(coalesce({text}, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), {_quoted(SQL_COPYRIGHT_LINE)}, '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


def _sql_words(prepared: str) -> str:
    return f"sha256(trim(regexp_replace({prepared}, {_quoted(NOT_WORD)}, ' ', 'g')))"


OP3_SQL = f"""
WITH known AS (SELECT {_sql_words(_sql_prepared("text"))} AS digest, min(license) AS license FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in LICENSES)}) l(license, text) GROUP BY 1),
d AS (SELECT doc_id, {_sql_prepared("text")} AS t FROM documents),
whole AS (SELECT doc_id, {_sql_words("t")} AS digest FROM d),
line AS (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) JOIN known ON {_sql_words("l")} = known.digest),
notices AS (SELECT doc_id, count(*) AS n_notices, string_agg(license, ',' ORDER BY license) AS notices FROM line GROUP BY 1)
SELECT doc_id, license, whole.digest, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON known.digest = whole.digest LEFT JOIN notices USING (doc_id)
"""
