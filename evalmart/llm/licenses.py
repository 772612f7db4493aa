"""Licence scans by canonical digest: texts are brought to one form and looked up by digest among known licences.

The form: lower case, copyright lines dropped, everything but letters and digits as single spaces, equivalent spellings as
one. Entire texts are joined by their digest; each line's form is also looked up among the known one-line notices, because
most documents carry a notice rather than a licence. A licence is known with and without its usual titles and an "All rights
reserved." line of its own; the long licences are the files of ``license_texts``, named by id. All of it is column expressions. The known digests are computed by the
same expressions from one table (``KNOWN``, also that of the SQL) and are a fixed list, the only thing broadcast.

Defined results: null, empty or purely decorative text has the digest of the empty text and no licence; a text equal to
several known licences gets the alphabetically first id; repeated rows are scanned each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmart.functions.text import bind
from evalmart.llm.common import text_of

# Wording of public licences (their texts in one line, without titles and copyright lines) and of usual notices.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
LICENSES = {
    "MIT": f"{_MIT_GRANT}, subject to the following conditions: {_MIT_NOTICE} {_MIT_WARRANTY}",
    "MIT-0": f"{_MIT_GRANT}. {_MIT_WARRANTY}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_WARRANTY}",
    "BSD-2-Clause": f"{_BSD_GRANT} {_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _MIT_WARRANTY.replace("OR COPYRIGHT HOLDERS ", "") + " For more information, please refer to <https://unlicense.org/>",
}
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}
# Usual titles of the licences above.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT License (Expat)", "Expat License"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT-0 License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD License", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License", "The BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Revised BSD License", "Modified BSD License", "BSD License", "The BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense", "The Unlicense (Unlicense)"],
}
_FILES = resources.files("evalmart.llm").joinpath("license_texts")
STANDARD = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in _FILES.iterdir() if f.name.endswith(".txt")}
_TITLED = [(k, f"{title}\n{rights}\n{v}") for k, v in LICENSES.items() for title in ["", *TITLES[k]] for rights in ("", "All rights reserved.") if title or rights]
# id, text of all that is known: plain, titled, and whole standard texts.
KNOWN = sorted([*{**NOTICES, **LICENSES}.items(), *_TITLED, *STANDARD.items()])
# Spellings that count as equal, in canonical form.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog",
    "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "favour": "favor", "fulfil": "fulfill",
    "initialise": "initialize", "judgement": "judgment", "labour": "labor", "merchantibility": "merchantability", "noncommercial": "non commercial", "organisation": "organization",
    "organise": "organize", "practise": "practice", "recognise": "recognize", "per cent": "percent", "owner": "holder", "owners": "holders", "https": "http",
}
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(copyright([^\p{L}\p{N}\n][^\n]*)?|©[^\n]*|\(c\)[ \t]*[0-9][^\n]*)$"


def canonical_lines(text: Column) -> Column:
    """Canonical form with its line ends kept; words are set off by spaces, every line begins and ends with some."""
    form = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT_LINE, "")
    form = F.concat(F.lit(" "), F.regexp_replace(form, r"[^\p{L}\p{N}\n]+", " "), F.lit(" "))
    form = F.replace(form, F.lit("\n"), F.lit(" \n "))
    for known, standard in SPELLINGS.items():
        form = F.replace(form, F.lit(f" {known} "), F.lit(f" {standard} "))
    return form


def canonical(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """digest, license_id: one row per digest."""
    rows = spark.createDataFrame(texts, "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def _known_lines(spark: SparkSession, notices: dict[str, str]) -> Column:
    """Canonical notice -> id, as a literal: the list is fixed and small."""
    rows = spark.createDataFrame(sorted(notices.items()), "id string, text string")
    forms = rows.groupBy(canonical(canonical_lines(F.col("text"))).alias("form")).agg(F.min("id").alias("id")).collect()
    return F.create_map(*(F.lit(x) for r in forms for x in (r["form"], r["id"])))


def license_scan(docs: DataFrame, licenses: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license_id (null if the text is no known licence), notices (ids of its notice lines, sorted, by comma)."""
    spark, notices = docs.sparkSession, NOTICES if notices is None else notices
    known = known_digests(spark, KNOWN if notices is NOTICES and licenses is None else sorted({**notices, **(LICENSES if licenses is None else licenses)}.items()))
    lines = _known_lines(spark, notices)
    forms = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bind(canonical_lines(text_of()), lambda form: F.struct(
        F.sha2(canonical(form), 256).alias("digest"),
        F.filter(F.transform(F.split(form, "\n"), lambda line: lines[F.trim(line)]), lambda x: x.isNotNull()).alias("found"),
    )).alias("_f"))
    scanned = forms.select("doc_id", F.col("_f.digest").alias("digest"), F.array_join(F.array_sort(F.array_distinct("_f.found")), ",").alias("notices"))
    return scanned.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license_id", "notices")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    form = f"regexp_replace(lower({text}), '(?m){COPYRIGHT_LINE}', '', 'g')"
    form = rf"' ' || regexp_replace({form}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') || ' '"
    form = f"replace({form}, chr(10), ' ' || chr(10) || ' ')"
    for known, standard in SPELLINGS.items():
        form = f"replace({form}, ' {known} ', ' {standard} ')"
    return form


def _sql_canonical(form: str) -> str:
    return rf"trim(regexp_replace({form}, '[ \n]+', ' ', 'g'))"


ORACLE_SQL = f"""
WITH notice(id, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in NOTICES.items())}),
known(id, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in KNOWN)}),
digests AS (SELECT sha256({_sql_canonical(_sql_lines("text"))}) AS digest, min(id) AS license_id FROM known GROUP BY 1),
forms AS (SELECT doc_id, {_sql_lines("coalesce(text, '')")} AS form FROM documents),
lines AS (SELECT doc_id, trim(unnest(string_split(form, chr(10)))) AS line FROM forms),
found AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notices FROM lines JOIN (SELECT id, {_sql_canonical(_sql_lines("text"))} AS line FROM notice) USING (line) GROUP BY doc_id),
scanned AS (SELECT doc_id, sha256({_sql_canonical("form")}) AS digest FROM forms)
SELECT s.doc_id, s.digest, d.license_id, coalesce(f.notices, '') AS notices
FROM scanned s LEFT JOIN digests d USING (digest) LEFT JOIN found f USING (doc_id)
"""
