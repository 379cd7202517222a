"""Licence digests: equivalent spellings match, other texts do not."""

from oracle_check import compare, connect

from vigilspark.llm import license_scan as ls
from vigilspark.llm.plans import ORACLES, QUERIES

from conftest import SF


def scanned(spark, texts):
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, uid int")
    return {r.doc_id: r for r in ls.scan(docs).collect()}


def test_query_equals_its_sql(spark):
    name = "op8_license_scan"
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) is None


def test_whole_texts(spark):
    variants = [
        "Copyright (c) 2020 Somebody <a@b.c>\n\n" + ls.MIT,
        " * " + ls.MIT.upper().replace("\n", "\n * ").replace('"', "'"),
        ls.MIT.replace("sublicense", "sub-licence".replace("-", "")).replace(", and to", " and to"),
        "© Them\nAll rights reserved.\n" + ls.MIT,
        ls.MIT + "\nplus one more term",
        ls.APACHE.replace("http://", "https://").replace("License", "Licence"),
        ls.ISC.replace("\n", "\r\n"),
    ]
    got = scanned(spark, variants)
    assert [got[i].text_license for i in range(7)] == ["MIT", "MIT", "MIT", "MIT", None, "Apache-2.0", "ISC"]
    assert len({got[i].digest for i in range(4)}) == 1


def test_lines_and_odd_rows(spark):
    texts = ["Words.\nReleased under the MIT licence!\nMore\n-- licensed under CC-BY-NC 4.0", None, "", "\n\n", "x" * 300_000,
             "Released under the MIT License."]
    got = scanned(spark, texts)
    assert (got[0].line_licenses, got[0].n_license_lines, got[0].text_license) == ("CC-BY-NC-4.0,MIT", 2, None)
    assert {got[i].line_licenses for i in range(1, 5)} == {""} and got[1].digest == got[3].digest
    assert (got[5].text_license, got[5].line_licenses) == ("MIT", "MIT")
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert ls.scan(docs).count() == 3 and ls.scan(docs.limit(0)).count() == 0


def test_python_and_spark_agree_on_the_canonical_form(spark):
    from pyspark.sql import functions as F

    lines = ["Licence, per cent!", "  Copyright (c) 2001 X", "copyright notice stays", "ÄÖ ß_é x-y", "# All Rights Reserved", "(c) y",
             "per cent per cent", "licence licence", "© z"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", ls.canonical(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == {x: ls.canonical_line(x) for x in lines}


def test_common_licences(spark):
    files = {name: text for name, text in ls._texts()[::2]}
    assert set(files) >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"}
    texts = list(files.values())
    texts += ["BSD 3-Clause License\n\nCopyright (c) 2019, X\n\n" + files["BSD-3-Clause"].replace("1.", "*").replace("2.", "*").replace("3.", "*")]
    got = scanned(spark, texts)
    assert [got[i].text_license for i in range(len(texts))] == [*files, "BSD-3-Clause"]
    lines = {"SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "// SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0",
             "                    GNU GENERAL PUBLIC LICENSE": "GPL", "This project is licensed under the MIT License.": "MIT",
             "Licensed under the Mozilla Public Licence, version 2.0": "MPL-2.0", "an unlicensed line about licence": "",
             "Distributed under the GNU Affero General Public License v3.0.": "AGPL-3.0"}
    found = scanned(spark, [f"words before\n{x}\nwords after" for x in lines])
    assert [found[i].line_licenses for i in range(len(lines))] == list(lines.values())


def test_known_licences_from_a_table(spark):
    known = spark.createDataFrame([("own-1", "Do what you like.\nBut ask."), ("own-2", "do WHAT you like, but ask"), (None, "x y"), ("own-3", None)], "id string, text string")
    docs = spark.createDataFrame([(1, "Copyright (c) me\ndo what you like but ask!"), (2, ls.MIT), (3, None), (4, "a\nX, Y\nb")], "doc_id long, text string")
    got = {r.doc_id: (r.text_license, r.n_license_lines) for r in ls.scan(docs, known).collect()}
    assert got == {1: ("own-1", 1), 2: (None, 0), 3: (None, 0), 4: (None, 1)}
    assert ls.scan(docs, known.limit(0)).count() == 4
