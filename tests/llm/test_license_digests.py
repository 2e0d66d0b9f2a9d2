"""Forms that count as one, and rows that are kept as they are."""

import os
import textwrap

import duckdb
import pytest

from labelquarry.llm.license_digests import DIGESTS, LICENSES, duckdb_sql, find_licenses, known_licenses

COPIES = "/usr/share/common-licenses"
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause-University", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
NOTICES = [
    "Copyright The Kubernetes Authors.", "Portions Copyright (c) 2020 Foo", "SPDX-License-Identifier: MIT", "# Copyright (C) the Example Project", "Copyright by the Some Contributors, 3",
    "Copyright 2019 Acme\nPortions copyright Else Inc.\nAll rights reserved.", "// Copyright (c) 1999-2003 the authors", "copyright the law says so", "Copyright notice below",
]


def test_equal_forms(spark):
    mit, bsd = LICENSES["MIT"], LICENSES["BSD-2-Clause"]
    rows = [
        (1, "MIT License copies say so" + mit, None), (2, mit.upper(), "MIT"), (3, "Copyright (c) 2020 Some One\n(C) 2021 Else\n\n" + mit, "MIT"),
        (4, mit.replace('"', "“").replace(",", " , ").replace("\n", " \r\n"), "MIT"), (5, bsd + "\nAll rights reserved.", "BSD-2-Clause"), (6, None, None), (7, "", None),
        (7, " \n.", None), (None, LICENSES["ISC"], "ISC"), (8, "This work is licenced under the GNU General Public Licence, version 3", None),
        (9, "released under the  MIT Licence!", "MIT-notice"), (9, "released under the  MIT Licence!", "MIT-notice"), (10, mit + " word" * 100000, None),
    ]
    df = spark.createDataFrame([(a, b, 1) for a, b, _ in rows], "doc_id long, text string, license_id int").repartition(3)
    out = find_licenses(df, known_licenses(spark)).collect()
    key = str
    assert sorted([(r.doc_id, r.text, r.license_id) for r in out], key=key) == sorted(rows, key=key)
    assert all(r.is_license == (r.license_id is not None) for r in out)
    assert find_licenses(df.limit(0), known_licenses(spark)).count() == 0


def test_more_licences_and_native_plan(spark):
    more = spark.createDataFrame([("Own", "My own licence, for all."), ("Empty", "..."), ("AAA", LICENSES["MIT"])], "license_id string, text string")
    known = known_licenses(spark, more)
    df = spark.createDataFrame([(1, "MY OWN LICENSE FOR ALL"), (2, ""), (3, LICENSES["MIT"])], "doc_id long, text string")
    found = find_licenses(df, known)
    assert {r.doc_id: r.license_id for r in found.collect()} == {1: "Own", 2: None, 3: "AAA"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_line_breaks_and_headings(spark):
    notice = "Copyright (c) 2020 Some One <one@example.org>\n\n"
    rows = []
    for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "Zlib"):
        for width in (30, 50, 72, 79):
            rows.append((name, "\n\n".join(textwrap.fill(part, width) for part in LICENSES[name].split("\n\n"))))
        rows.append((name, "\n".join(LICENSES[name].split(" "))))
    for heading, name in (("MIT License", "MIT"), ("The MIT License (MIT)", "MIT"), ("ISC License", "ISC"), ("BSD 2-Clause License", "BSD-2-Clause"), ("zlib License", "Zlib")):
        rows.append((name, f"{heading}\n\n{notice}{textwrap.fill(LICENSES[name], 70)}"))
    for line in ("Copyright 2019-2021 Acme", "Copyright Acme Corp.", "copyright: by Some One", "© Else", "(c) Copyright 2001 Else", "* Copyright (C) Else", "Copyright Øre"):
        rows.append(("ISC", f"{line}\n{LICENSES['ISC']}"))
    rows += [(None, "MIT License"), (None, "ISC License\n\n" + LICENSES["MIT"]), (None, "(c) You must retain all notices\n" + LICENSES["MIT"])]
    df = spark.createDataFrame(rows, "wanted string, text string")
    assert [(r.wanted, r.text) for r in find_licenses(df, known_licenses(spark)).collect() if r.license_id != r.wanted] == []


@pytest.mark.skipif(not os.path.isdir(COPIES), reason="no copies of public licences")
def test_whole_licences(spark):
    assert set(FILES.values()) == set(DIGESTS)
    texts = {name: open(f"{COPIES}/{file}", encoding="utf-8").read() for file, name in FILES.items() if os.path.exists(f"{COPIES}/{file}")}
    rows = []
    for name, text in texts.items():
        rows += [(name, text), (name, text.upper()), (name, f"SPDX-License-Identifier: {name}\nCopyright 2020 The Example Authors\n\n{text}"), (None, text[:-40]), (None, text + " more")]
        # An exhibit with notices of its own is told apart from its text by line breaks.
        own = any(line.strip().lower().startswith(("copyright", "portions", "all rights reserved")) for line in text.splitlines())
        rows.append((name, text if own else " ".join(text.split())))
    df = spark.createDataFrame(rows, "wanted string, text string")
    assert [(r.wanted, r.license_id, r.text[:60]) for r in find_licenses(df, known_licenses(spark)).collect() if r.license_id != r.wanted] == []


def test_notices_and_their_sql(spark):
    mit = LICENSES["MIT"]
    texts = [f"{n}\n\n{mit}" for n in NOTICES] + [None, "", "©", "(c)", "copyright", "x\ncopyright (c) 2001", mit + "\n© 2003 É", "Copyright Øre\n" + mit, "the copyright the authors\n" + mit]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.canonical_sha256, r.license_id) for r in find_licenses(df, known_licenses(spark)).collect()}
    assert [got[i][1] for i in range(len(NOTICES))] == ["MIT", "MIT", "MIT", "MIT", "MIT", "MIT", "MIT", None, None]
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents)
    assert {d: (h, name) for d, h, name, _ in con.execute(duckdb_sql()).fetchall()} == got
