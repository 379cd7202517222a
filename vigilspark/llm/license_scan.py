"""Licence scan by canonical digest: whole texts, and whole lines, against known licences.

A text is normalised line by line: lower case, copyright lines dropped, letters
and digits only, one spelling for equivalent words. The digest of the whole
canonical text, and that of each line, are joined to the digests of known
licences. All of it is DataFrame functions.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import configure, written

# Licence texts and notices as published; fixed values.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
NOTICES = [
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("Apache-2.0", APACHE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]
#: Licences with the names that notices and titles give them; fixed values.
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)", "Expat License"], "ISC": ["ISC License"], "Unlicense": ["Unlicense", "The Unlicense"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2 license"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3 license"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal"], "Zlib": ["zlib License"], "GPL": ["GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License"], "AGPL": ["GNU Affero General Public License"],
}
SENTENCES = ["{}", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.",
             "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is licensed under the {}.",
             "This software is released under the {}.", "This file is licensed under the {}."]
VERSIONED = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")


def _texts() -> list[tuple[str, str]]:
    """The full texts that come with this module, also without the numbers of their list items."""
    out = []
    for file in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        out += [(file.name.removesuffix(".txt"), x) for x in (text, re.sub(r"(?m)^\s*\d\.", "", text))]
    return out


def default_licenses() -> list[tuple[str, str]]:
    """(licence, text) of all known texts and notices; the first licence of equal texts counts."""
    named = [(key, sentence.format(name)) for key, names in NAMES.items() for name in names for sentence in SENTENCES]
    titled = [(key, f"{name}\n{text}") for key, text in _texts() for name in NAMES.get(key, [])]
    marks = [(key, f"SPDX-License-Identifier: {key}{end}") for key in NAMES if any(c.isdigit() for c in key) or key in ("MIT", "ISC", "Unlicense", "Zlib")
             for end in ("", *(("-only", "-or-later") if key in VERSIONED else ()))]
    return [*NOTICES, *_texts(), *titled, *named, *marks]


# Equivalent words of licence matching guidelines, after punctuation is gone; fixed values.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("favour", "favor"), ("fulfil", "fulfill"), ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"),
    ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("https", "http"),
]
COPYRIGHT = r"^[\s#/*;%!-]*(copyright\s+(\(c\)|©|\d{4}|by\b)|\(c\)\s|©|all rights reserved).*$"
#: Known digests that may be sent to every task; a longer list is left to the planner.
BROADCAST_ROWS = 10_000


def canonical_line(line: str) -> str:
    """The same rule in Python, for the known texts."""
    line = line.lower()
    if re.match(COPYRIGHT, line):
        return ""
    words = f" {re.sub(r'[\W_]+', ' ', line).strip()} "
    for old, new in SPELLINGS:
        words = words.replace(f" {old} ", f" {new} ")
    return words.strip()


def canonical_text(text: str) -> str:
    return " ".join(x for x in map(canonical_line, text.split("\n")) if x)


def canonical(line: Column) -> Column:
    low = F.lower(line)
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(words))


@cache
def _default_digests() -> dict[str, tuple[str, int]]:
    return known_digests(default_licenses())


def known_digests(known: list[tuple[str, str]] | None) -> dict[str, tuple[str, int]]:
    """digest -> (licence, canonical length); the first licence of equal texts."""
    if known is None:
        return _default_digests()
    out: dict[str, tuple[str, int]] = {}
    for name, text in known:
        plain = canonical_text(text)
        out.setdefault(hashlib.sha256(plain.encode()).hexdigest(), (name, len(plain)))
    return out


def digest_table(known: DataFrame) -> DataFrame:
    """``digest, license, n`` of a table of known licences (``id``, ``text``); the least id of equal texts."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), canonical)
    plain = known.select(F.col("id").cast("string").alias("license"), F.array_join(F.filter(lines, lambda x: x != ""), " ").alias("p"))
    return plain.filter("p != ''").groupBy(F.sha2("p", 256).alias("digest")).agg(
        F.min("license").alias("license"), F.first(F.length("p")).alias("n"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """One row per document: its canonical digest, its licence as a whole, the licences of its lines.

    ``known`` is a list of (licence, text) or a table with ``id`` and ``text`` of any size; by
    default the texts, names and notices of this module.

    ``text_license`` is null when the whole text is no known licence, ``line_licenses``
    an ordered comma-separated list (empty when no line is one). Null text is an
    empty one; empty lines match nothing; a licence text of several lines is found
    as a whole text. Null and repeated ids are kept row by row; other columns are
    ignored; an empty table gives no rows.
    """
    spark = configure(docs.sparkSession)
    if isinstance(known, DataFrame):
        table = written(digest_table(known), "licenses")
        span = table.agg(F.coalesce(F.min("n"), F.lit(1)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
        fits, number, table = lambda n: n.between(span[0], span[1]), span[2], table.drop("n")
    else:
        digests = known_digests(known)
        lengths = sorted({n for _, n in digests.values()})
        fits, number = lambda n: n.isin(*lengths), len(digests)
        table = spark.createDataFrame([(d, n) for d, (n, _) in digests.items()], "digest string, license string")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), canonical)
    text = F.array_join(F.filter("_l", lambda x: x != ""), " ")
    # Only a line as long as some known licence can be one; the others need no digest.
    likely = F.filter("_l", lambda x: fits(F.length(x)))
    rows = docs.select(F.col("doc_id").cast("long"), lines.alias("_l")).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.sha2(text, 256).alias("digest"),
        F.transform(likely, lambda x: F.sha2(x, 256)).alias("lines"),
    )
    rows = written(rows, "digests")
    if number <= BROADCAST_ROWS:
        table = F.broadcast(table)
    found = rows.select("uid", F.explode("lines").alias("digest")).join(table, "digest")
    per = found.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"),
                                   F.count("*").alias("n_license_lines"))
    whole = rows.select("uid", "doc_id", "digest").join(table, "digest", "left")
    return whole.join(per, "uid", "left").select(
        "doc_id", "digest", F.col("license").alias("text_license"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
    )


def _canonical_sql(x: str) -> str:
    words = f"' ' || trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        words = f"replace({words}, ' {old} ', ' {new} ')"
    return f"CASE WHEN regexp_matches(lower({x}), '{COPYRIGHT}') THEN '' ELSE trim({words}) END"


def oracle_sql(known: list[tuple[str, str]] | None = None) -> str:
    values = ", ".join(f"('{d}', '{n}')" for d, (n, _) in known_digests(known).items())
    return f"""
WITH known(digest, license) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS uid, doc_id,
        list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_canonical_sql('x')}) AS l FROM documents),
f AS (SELECT uid, license FROM (SELECT uid, sha256(unnest(l)) AS digest FROM d) JOIN known USING (digest)),
p AS (SELECT uid, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM f GROUP BY uid)
SELECT doc_id, sha256(array_to_string(list_filter(l, lambda x: x <> ''), ' ')) AS digest, k.license AS text_license,
  coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
FROM d LEFT JOIN p USING (uid) LEFT JOIN known k
  ON k.digest = sha256(array_to_string(list_filter(l, lambda x: x <> ''), ' '))
"""
