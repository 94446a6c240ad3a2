"""Operator 4: license scans by lookup of canonical digests.

A text is brought to canonical form - lower case, copyright lines dropped, punctuation to
blanks, equivalent spellings to one - and its digest joined with those of known license texts
and notices.  Units are whole texts and, so that a notice inside another text is found, single lines; each
is compared as an entire unit.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digests that are broadcast; 64 characters each and a name.
MOST_KNOWN = 100_000

# Words with equivalent spellings, after punctuation has gone.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "copyright holder": "copyright owner",
    "emphasised": "emphasized",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "optimise": "optimize",
    "organisation": "organization",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "http": "https",
}

# Public license texts and short notices.
LICENSES: list[tuple[str, str]] = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©)(?:[^\n]*(?:19|20)[0-9]{2})[^\n]*$"

#: Also without a year; lines of wrapped license texts may begin with the word, too.
ANY_COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:(?:copyright\b|\(c\)|©)[^\n]*(?:19|20)[0-9]{2}|copyright[ \t]*(?:\(c\)|©|:)|(?:\(c\)|©)[ \t]*copyright\b|©|all rights reserved\b|copyright[ \t]+(?!(?:[a-z]*ed|"
    r"holders?|owners?|notices?|laws?|licen[sc]es?|interests?|statements?|acts?|treat(?:y|ies)|permissions?|and|or|in|on|of|to|the|is|are|does|for|rights?|"
    r"disclaimers?|infringement|ownership|status|material|protection|terms|as|may|that|which|will|works?|resulting)\b)\p{L})[^\n]*$"
)

# Licenses with the names that notices give them.
NAMED = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0 license", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 license", "Apache License"],
    "Artistic-1.0": ["Artistic License 1.0", "Artistic License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause license"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal License"],
    "GFDL-1.2": ["GNU Free Documentation License, version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, version 1.3"],
    "GPL-1.0": ["GNU General Public License, version 1"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0 license", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0 license", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.0": ["GNU Library General Public License, version 2"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1 license"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0 license", "LGPLv3"],
    "MIT": ["MIT License", "MIT"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0 license"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}
SAID = "{0}.|Licensed under {0}.|Licensed under the {0}.|Released under {0}.|Released under the {0}.|Distributed under the {0}.|This work is licensed under {0}.|This work is licensed under the {0}.|This work is licensed under a {0}.|This software is licensed under the {0}.|This project is licensed under the {0}.".split("|")
FORMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
BSD3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED"""
TEXTS = {"Artistic": "Artistic-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}


def public() -> list[tuple[str, str]]:
    """``LICENSES`` and further public licenses: texts with and without their titles and what follows
    their terms, and notices."""
    found = list(LICENSES)
    full = {name: text for name, text in LICENSES if "\n" in text}
    full["BSD-3-Clause"] = full["BSD-2-Clause"].replace("\nTHIS SOFTWARE IS PROVIDED", BSD3)
    for name, text in full.items():
        found += [(name, text), *((name, f"{head}{title}\n{text}") for title in NAMED[name] for head in ("", "The "))]
        found += [(name, f"{head}{title} ({name})\n{text}") for title in NAMED[name] for head in ("", "The ")]
    for file in sorted((Path(__file__).parent / "license_texts").iterdir()):
        name, text = TEXTS.get(file.name, file.name), file.read_text()
        ends = [text, *(text[: i + n] for i in [text.find("END OF TERMS AND CONDITIONS")] if i >= 0 for n in (0, 27))]
        found += [(name, t) for end in ends for t in (end, end.lstrip().partition("\n")[2])]
    for name, titles in NAMED.items():
        found += [(name, said.format(title)) for title in titles for said in SAID if said != "{0}." or title not in ("MIT", "Unlicense")]
        found += [(name, f"SPDX-License-Identifier: {name}{end}") for end in (("", "-only", "-or-later") if "GPL" in name or "GFDL" in name else ("",))]
    for form, words in FORMS.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            kind = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            name, long = f"CC-{form}-{version}", [w for w in {words, words.replace("NoDerivatives", "NoDerivs"), words.replace("NonCommercial", "Noncommercial"), words.replace("ShareAlike", "Share Alike")}]
            titles = [f"CC {form} {version}", f"CC-{form}-{version} license", f"CC {form} {version} license"]
            titles += [f"Creative Commons {w} {version}{k}{end}" for w in long for k in ("", f" {kind}") for end in ("", " License")]
            found += [(name, said.format(t)) for t in titles for said in SAID] + [(name, f"SPDX-License-Identifier: {name}")]
    return sorted(set(found))


def canonical(text: Column, copyright_line: str = COPYRIGHT_LINE) -> Column:
    """Canonical form, with one blank between words; null stays null.  Every word has two blanks of its own while spellings
    are replaced, so neighbours don't share one."""
    low = F.regexp_replace(F.lower(text), copyright_line, " ")
    words = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for said, meant in SPELLINGS.items():
        words = F.replace(words, F.lit(_spaced(said)), F.lit(_spaced(meant)))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(text: Column, copyright_line: str = COPYRIGHT_LINE) -> Column:
    return F.sha2(canonical(text, copyright_line).cast("binary"), 256)


def catalogue(spark: SparkSession, known: list[tuple[str, str]] | None = None, copyright_line: str = COPYRIGHT_LINE) -> DataFrame:
    """``digest, license`` of known texts: the built-in ones or the given (name, text) pairs."""
    rows = spark.createDataFrame(LICENSES if known is None else known, "license string, text string")
    return rows.select(digest(F.col("text"), copyright_line).alias("digest"), "license").distinct()


def scan_licenses(df: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", copyright_line: str = COPYRIGHT_LINE) -> DataFrame:
    """``id_col, text_digest, whole string, licenses string`` for every row: the digest of the
    canonical whole text, the license that the whole text is (or null) and all licenses found as
    whole text or as a line, sorted and joined with commas (or empty).

    Whole texts and their lines meet the catalogue in hash joins; up to ``MOST_KNOWN`` of its digests are broadcast, so that no line crosses the
    network, and more are joined by shuffling digests.  What is found is put together by id and text, which rows that repeat share: they
    are counted and given again.  Null text: null digest, nothing found.  Repeated rows repeat; if the catalogue gives one
    digest several names, the first by name counts."""
    table = catalogue(df.sparkSession, known, copyright_line).groupBy("digest").agg(F.min("license").alias("license"))
    if table.count() <= MOST_KNOWN:
        table = F.broadcast(table)
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).alias("__id"), text.alias("__text"))
    docs = docs.select("__id", F.unhex(F.md5("__text")).alias("__of"), digest(F.col("__text"), copyright_line).alias("text_digest"), F.split("__text", "\n").alias("__lines"))
    unit = F.struct(F.lit(True).alias("entire"), F.col("text_digest").alias("digest"))
    lines = F.transform("__lines", lambda x: F.struct(F.lit(False).alias("entire"), digest(x, copyright_line).alias("digest")))
    units = docs.select("__id", "__of", F.explode(F.concat(F.array(unit), F.coalesce(lines, F.array().cast("array<struct<entire:boolean,digest:string>>")))).alias("u"))
    found = units.select("__id", "__of", "u.*").join(table, "digest", "left")
    rows = found.groupBy("__id", "__of").agg(
        F.max(F.when(F.col("entire"), F.col("digest"))).alias("text_digest"),
        F.max(F.when(F.col("entire"), F.col("license"))).alias("whole"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count_if("entire").alias("__n"),
    )
    copies = rows.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    return copies.select(F.col("__id").alias(id_col), "text_digest", "whole", "licenses")


def _sql_canonical(text: str) -> str:
    low = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g')"
    words = f"concat(' ', regexp_replace({low}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'), ' ')"
    for said, meant in SPELLINGS.items():
        words = f"replace({words}, '{_spaced(said)}', '{_spaced(meant)}')"
    return f"trim(replace({words}, '  ', ' '))"


def oracle() -> str:
    """The scan with ``public()`` over ``documents`` in DuckDB's SQL."""
    rows = ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in pair)) for pair in public())
    return f"""
    WITH known AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(license) AS license FROM (VALUES {rows}) v(license, t) GROUP BY 1),
    d AS (SELECT doc_id, text, sha256({_sql_canonical("text")}) AS text_digest FROM documents),
    units AS (
        SELECT doc_id, text_digest AS digest FROM d
        UNION ALL SELECT doc_id, sha256({_sql_canonical("line")}) FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    ),
    found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM units JOIN known USING (digest) GROUP BY doc_id)
    SELECT d.doc_id, d.text_digest, k.license AS whole, coalesce(f.licenses, '') AS licenses
    FROM d LEFT JOIN known k ON k.digest = d.text_digest LEFT JOIN found f ON f.doc_id = d.doc_id"""
