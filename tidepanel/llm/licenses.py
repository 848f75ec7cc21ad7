"""Licence scan by canonical digests.

A text, and every paragraph and line of it, is reduced to a canonical form: case, copyright lines, punctuation,
small words and equivalent spellings go. Its SHA-256 is joined to the digests of known licences in the same form.
The registry holds the whole texts of short licences and the standard headers of long ones, each with its paragraphs,
and the usual notices, made from templates. It is a small fixed table, so the join is a broadcast one; a caller's
table is joined as Spark sees fit. A licence of several paragraphs counts when all are there, as the paragraphs of
one layout; one that is contained in another (``CONTAINED``) does not count beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence identifiers with the names notices use.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"],
}
NOTICES = (
    "Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "Published under {}",
    "Licensed under the terms of {}", "Distributed under the terms of {}", "Released under the terms of {}",
    "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}",
    "This file is licensed under {}", "This code is licensed under {}", "SPDX-License-Identifier: {}", "License: {}",
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_INTRO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:"
)
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.",
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest "
    "in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
    "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
    "rights to this software under copyright law.",
    _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"),
]
_APACHE_END = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS '
    'IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License."
)


def _bsd(n: int) -> list[list[str]]:
    """Clauses numbered or as a list, each a paragraph or all in one."""
    clauses = _BSD_CLAUSES[:n]
    styles = [f"{i}. {c}" for i, c in enumerate(clauses, 1)], [f"* {c}" for c in clauses]
    return [[_BSD_INTRO, *middle, _BSD_END] for style in styles for middle in (style, ["\n".join(style)])]


def _gnu(name: str, version: int, subject: str) -> list[list[str]]:
    """The standard header, with the address or the link at its end."""
    ends = (
        "If not, see <https://www.gnu.org/licenses/>.", "If not, see <https://www.gnu.org/licenses>.",
        "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    )
    return [
        [
            f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published "
            f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
            f"This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
            f"You should have received a copy of the GNU {name} along with this {subject}. {end}",
        ]
        for end in ends
    ]


def _commons(code: str, name: str) -> list[list[str]]:
    notice = (
        f"This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit "
        f"http://creativecommons.org/licenses/{code}/4.0/"
    )
    return [[notice], [f"{notice} or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."]]


# Whole texts or standard headers without copyright lines, each wording a list of paragraphs.
TEXTS = {
    "MIT": [[
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS,
    ]],
    "ISC": [[
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        _ISC_END,
    ]],
    "0BSD": [[
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        _ISC_END,
    ]],
    "Apache-2.0": [
        [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
            "License. You may obtain a copy of the License at",
            "http://www.apache.org/licenses/LICENSE-2.0",
            _APACHE_END,
        ],
    ],
    "GPL-2.0": _gnu("General Public License", 2, "program"),
    "GPL-3.0": _gnu("General Public License", 3, "program"),
    "LGPL-3.0": _gnu("Lesser General Public License", 3, "program") + _gnu("Lesser General Public License", 3, "library"),
    "AGPL-3.0": _gnu("Affero General Public License", 3, "program"),
    "MPL-2.0": [
        [
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            f"distributed with this file, You can obtain one at http://{host}mozilla.org/MPL/2.0/."
        ]
        for host in ("", "www.")
    ],
    "BSD-2-Clause": _bsd(2),
    "BSD-3-Clause": _bsd(3),
    "Unlicense": [
        _UNLICENSE, [*_UNLICENSE, "For more information, please refer to <http://unlicense.org/>"],
        [*_UNLICENSE, "For more information, please refer to <http://unlicense.org>"],
    ],
    "CC0-1.0": [[
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty.",
        "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see "
        "<http://creativecommons.org/publicdomain/zero/1.0/>.",
    ]],
    "CC-BY-4.0": _commons("by", "Attribution"),
    "CC-BY-SA-4.0": _commons("by-sa", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _commons("by-nc", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _commons("by-nd", "Attribution-NoDerivatives"),
}
# A licence all of whose paragraphs are in another one, with that one.
CONTAINED = {"BSD-2-Clause": "BSD-3-Clause"}

# Spellings that mean the same, after case and punctuation went; applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("organisation", "organization"), ("non commercial", "noncommercial"),
    ("share alike", "sharealike"), ("no derivatives", "noderivatives"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("and or", "or"),
    ("copyright (owners?|holders?)", "copyright holders"), ("https", "http"), ("v([0-9])", "$1"), ("(version|the|an|a)", ""),
)
#: Lines of this form carry a name and a year, not terms. A wrapped line of terms may begin with the word as well.
COPYRIGHT_LINE = (
    r"(?m)^[ \t]*(copyright[ \t:]*(\(c\)|\x{a9}|by )|copyright[^\n]*[0-9]{4}|copyright the [^\n]*(authors|contributors|developers)"
    r"|\(c\)[ \t]*copyright|\(c\)[^\n]*[0-9]{4}|\x{a9}|all rights reserved)[^\n]*$"
)
OTHER_CHARACTERS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, OTHER_CHARACTERS, "  "), F.lit(" "))  # two blanks: each word has its own pair
    for old, new in SPELLINGS:
        words = old.replace(" ", "  ")
        out = F.regexp_replace(out, f" {words} ", f" {new} ")
    return F.trim(F.regexp_replace(out, " +", " "))


def canonical_sql(expr: str) -> str:
    """The same form in the reference engine's SQL."""
    out = f"regexp_replace(translate({expr}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '', 'g')"
    out = f"concat(' ', regexp_replace({out}, '{OTHER_CHARACTERS}', '  ', 'g'), ' ')"
    for old, new in SPELLINGS:
        words = old.replace(" ", "  ")
        new = new.replace("$1", "\\1")
        out = f"regexp_replace({out}, ' {words} ', ' {new} ', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def entries() -> list[tuple[str, int, int, str]]:
    """(licence, part, parts, text); part 0 is a whole text, with or without its title, or a notice; the others are
    paragraphs. Wordings of equally many paragraphs share the numbers of the parts.
    """
    out = [(spdx, 0, 1, notice.format(name)) for spdx, names in NAMES.items() for name in names for notice in NOTICES]
    for spdx, wordings in TEXTS.items():
        for paragraphs in wordings:
            whole = "\n\n".join(paragraphs)
            out += [(spdx, 0, 1, whole), *[(spdx, 0, 1, f"{name}\n\n{whole}") for name in NAMES.get(spdx, ())]]
            out += [(spdx, i + 1, len(paragraphs), p) for i, p in enumerate(paragraphs)]
    return list(dict.fromkeys(out))


def registry(spark: SparkSession, known: list[tuple[str, int, int, str]] | None = None) -> DataFrame:
    """digest and an array of (licence, part, parts) with that digest."""
    rows = spark.createDataFrame(known or entries(), "license string, part int, parts int, text string")
    digest = F.sha2(canonical(F.col("text")), 256)
    return rows.groupBy(digest.alias("digest")).agg(F.collect_set(F.struct("license", "part", "parts")).alias("known"))


def scan(docs: DataFrame, text: str = "text", known: list[tuple[str, int, int, str]] | None = None) -> DataFrame:
    """doc_id, n_units, n_matched, licenses (sorted, comma-joined), whole_text (the whole text is a licence) per row.

    Units are the whole text, its paragraphs and its lines; those whose canonical form is empty do not count. Null
    and empty texts have no unit. Repeated rows are reported each. An empty table gives an empty result.
    """
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select("doc_id", raw.alias("raw"), F.monotonically_increasing_id().alias("row"))
    lined = F.split(F.col("raw"), "\n")
    paragraphs = F.split(F.col("raw"), r"\n[ \t\r]*\n")
    tag = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("unit"))
    units = F.concat(
        F.array(tag("text")(F.col("raw"))),
        F.when(F.size(paragraphs) > 1, F.transform(paragraphs, tag("paragraph"))).otherwise(F.array().cast("array<struct<kind:string,unit:string>>")),
        F.when(F.size(lined) > 1, F.transform(lined, tag("line"))).otherwise(F.array().cast("array<struct<kind:string,unit:string>>")),
    )
    each = rows.select("doc_id", "row", F.explode(units).alias("u")).select("doc_id", "row", "u.kind", canonical(F.col("u.unit")).alias("form"))
    known_digests = registry(docs.sparkSession, known)
    if known is None:
        known_digests = F.broadcast(known_digests)
    joined = each.withColumn("digest", F.sha2("form", 256)).join(known_digests, "digest", "left")
    hit = F.col("known").isNotNull() & (F.col("form") != "")
    found = joined.groupBy("row", "doc_id").agg(
        F.count(F.when(F.col("form") != "", 1)).alias("n_units"),
        F.count(F.when(hit, 1)).alias("n_matched"),
        F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("known"))))).alias("parts"),
        F.max(F.coalesce(hit & (F.col("kind") == "text") & F.exists("known", lambda k: k["part"] == 0), F.lit(False))).alias("whole_text"),
    )
    parts_there = lambda p: F.size(
        F.filter("parts", lambda q: (q["license"] == p["license"]) & (q["parts"] == p["parts"]) & (q["part"] > 0))
    )
    of = lambda keep: F.transform(F.filter("parts", keep), lambda p: p["license"])
    by_parts = found.withColumn("by_parts", of(lambda p: (p["part"] > 0) & (parts_there(p) == p["parts"])))
    inner = F.create_map(*[F.lit(x) for pair in CONTAINED.items() for x in pair])
    alone = F.filter("by_parts", lambda x: ~F.coalesce(F.array_contains("by_parts", inner[x]), F.lit(False)))
    names = F.array_sort(F.array_union(alone, of(lambda p: p["part"] == 0)))
    return by_parts.select("doc_id", "n_units", "n_matched", F.array_join(names, ",").alias("licenses"), "whole_text")


def oracle() -> str:
    """Reference SQL of ``scan`` over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(i)}, {part}, {parts}, {quote(t)})" for i, part, parts, t in entries())
    pairs = ", ".join(f"({quote(inside)}, {quote(by)})" for inside, by in CONTAINED.items())
    return f"""
WITH reg AS (SELECT DISTINCT license, part, parts, {canonical_sql("t")} AS form FROM (VALUES {values}) v(license, part, parts, t)),
d AS (SELECT doc_id, coalesce(text, '') AS raw, string_split(coalesce(text, ''), chr(10)) AS l,
        regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n') AS p FROM documents),
u AS (SELECT doc_id, 'text' AS kind, raw AS unit FROM d
      UNION ALL SELECT doc_id, 'paragraph', unnest(p) FROM d WHERE len(p) > 1
      UNION ALL SELECT doc_id, 'line', unnest(l) FROM d WHERE len(l) > 1),
c AS (SELECT doc_id, kind, {canonical_sql("unit")} AS form FROM u),
m AS (SELECT DISTINCT c.doc_id, c.kind, reg.license, reg.part, reg.parts FROM c JOIN reg ON c.form = reg.form WHERE c.form <> ''),
by_parts AS (SELECT doc_id, license FROM (SELECT DISTINCT doc_id, license, part, parts FROM m WHERE part > 0) GROUP BY doc_id, license, parts
      HAVING count(*) = parts),
contained(license, outer_license) AS (VALUES {pairs}),
full_parts AS (SELECT doc_id, license FROM by_parts b WHERE NOT EXISTS (SELECT 1 FROM contained c JOIN by_parts o ON o.license = c.outer_license
        WHERE c.license = b.license AND o.doc_id = b.doc_id) UNION SELECT doc_id, license FROM m WHERE part = 0),
n AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM full_parts GROUP BY doc_id),
k AS (SELECT doc_id, count(*) FILTER (WHERE form <> '') AS n_units,
        count(*) FILTER (WHERE form <> '' AND form IN (SELECT form FROM reg)) AS n_matched FROM c GROUP BY doc_id)
SELECT k.doc_id, n_units, n_matched, coalesce(n.licenses, '') AS licenses,
       k.doc_id IN (SELECT doc_id FROM m WHERE kind = 'text' AND part = 0) AS whole_text
FROM k LEFT JOIN n USING (doc_id)"""
