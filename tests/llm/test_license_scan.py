import textwrap

from factloom.llm.license_scan import LICENSES, scan_licenses
from factloom.llm.license_texts import read


def test_equivalent_texts_and_near_misses(spark):
    mit = LICENSES[0][1]
    rows = [
        (1, mit), (2, mit.upper().replace("Copyright (c) year holder", "").replace("COPYRIGHT (C) YEAR HOLDER", "  Copyright 1999-2024 Some One, all rights reserved")), (3, mit.replace("\n", "  \r\n").replace(",", " ,").replace("license", "licence").replace("License", "Licence")),
        (4, mit + " more"), (5, mit[:-20]), (6, "text\nRELEASED under the mit licence\nLicensed under CC-BY-NC 4.0!\nmore"), (7, "not Released under the MIT License. at all"), (8, None), (9, ""), (9, "..."), (None, "Licensed under the Apache License, Version 2.0"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {}
    for r in scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.n_notices, r.notices))
    assert [got[k][0][0] for k in range(1, 8)] == ["MIT", "MIT", "MIT", None, None, None, None]
    assert got[6] == [(None, 2, "CC-BY-NC-4.0,MIT")] and got[7] == [(None, 0, "")]
    assert got[8] == [(None, 0, "")] and got[9] == [(None, 0, "")] * 2 and got[None] == [("Apache-2.0", 1, "Apache-2.0")]
    assert scan_licenses(df.limit(0)).count() == 0
    assert {r.license for r in scan_licenses(df, []).collect()} == {None}


def test_entire_published_texts(spark):
    title = "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n"
    mit, isc, bsd2 = LICENSES[0][1], LICENSES[1][1], read("BSD-2-Clause")
    bsd3 = bsd2.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE", 1)
    gpl2 = read("GPL-2.0-only")
    texts = [
        ("Apache-2.0", title + read("Apache-2.0")), ("Apache-2.0", title + read("Apache-2.0").split("   APPENDIX")[0]), ("GPL-2.0-only", gpl2), ("GPL-2.0-only", gpl2.split("How to Apply")[0].rsplit("\n", 1)[0]),
        *((n, read(n)) for n in ("GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0", "BSL-1.0", "Zlib", "0BSD", "OFL-1.1")),
        ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + bsd2), ("BSD-3-Clause", "Copyright (c) 2020, Some One\n\n" + bsd3.replace("\n1. ", "\n * ").replace("\n2. ", "\n * ").replace("\n3. ", "\n * ")),
        ("MIT", mit.replace("MIT License", "The MIT License (MIT)", 1)), ("MIT", mit.split("\n", 1)[1]), ("ISC", "ISC License\n\nCopyright (c) 2020, Some One\n\n" + isc), (None, gpl2[:-200]), (None, bsd3.replace("Neither", "Either")),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in scan_licenses(df).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]


def test_published_line_breaks_and_comments(spark):
    isc = """Copyright (c) 2020, Some One <one@example.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
    flat = isc.split("\n\n", 1)[1]
    heads = ["Copyright 2020 X", "(c) 2020 X", "© X", "Copyright Some One", "Copyright by some one", "Copyright [yyyy] [name of copyright owner]", "COPYRIGHT (C) X", "Copyright the Regents", "(C) Copyright X", "SPDX-FileCopyrightText: 2020 X", "copyright: 2019-2020 x"]
    texts = [(isc, "ISC")] + [(f"{head}\n\n{flat}", "ISC") for head in heads]
    for lead in ("# ", "// ", " * ", "-- ", ";; ", "% "):
        texts.append(("".join(lead + line + "\n" for line in isc.split("\n")), "ISC"))
    texts.append(("/*\n" + "".join(f" * {line}\n" for line in isc.split("\n")) + " */\n", "ISC"))
    mit = LICENSES[0][1].split("\n", 1)[1]
    for width in range(40, 100):
        wrapped = "\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in flat.replace("\n\n", "\0").replace("\n", " ").split("\0"))
        texts.append((wrapped, "ISC"))
        texts.append(("Copyright 2020 X\n" + "\n".join(textwrap.fill(p, width) for p in mit.split("\n")[2:]), "MIT"))
    texts += [("copyright is nothing of a licence\n" + flat, None), ("Copyright Notice and other terms hold\n" + flat, None), ("(c) You must keep this\n" + flat, None)]
    got = {r.doc_id: r.license for r in scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [(i, got[i]) for i in range(len(texts))] == [(i, name) for i, (_, name) in enumerate(texts)]


def test_a_very_long_text_and_repeats(spark):
    long = "plain words go on and on\n" * 40000 + "Released under the MIT License.\n" * 3
    df = spark.createDataFrame([(1, long), (1, long), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.n_notices, r.notices) for r in scan_licenses(df).collect())
    assert got == [(1, None, 1, "MIT"), (1, None, 1, "MIT"), (2, None, 0, "")]
