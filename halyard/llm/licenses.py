"""License scan by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: ASCII letters in lower case, copyright
notices dropped (lines where a sign, a year or a placeholder follows the word,
not lines of a body that begin with it), so are titles of short licences and
lines of a holder without a year before the body, equivalent spellings unified,
and whatever isn't a letter, digit or non-ASCII character turned into single
blanks.  The SHA-256 of the whole
canonical text is joined by equality with the digests of known licences, which
are made by the same expression.  The known table is a constant of this module
with the full texts in ``license_texts`` (or the caller's, of at most ``MAX_BROADCAST`` rows to be broadcast; a larger one
is joined by an ordinary shuffled hash join).

Defined cases: null texts count as empty and match nothing; a text matches as a
whole or not at all; equal rows get equal results; a column named like a result
column is replaced.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import unclashed

MAX_BROADCAST = 10_000
#: A notice, anywhere: "copyright", then a sign, a year or a placeholder; a sign, then a year or the word.
NOTICE_LINE = r"(^|\n)[ \t#/*;-]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|[<\[{])[^\n]*|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]{4}|[<\[{])[^\n]*|all rights reserved[. \t\r]*(?=\n|$))"
#: Before the body: titles of the licences that are often given without one, and holders without a year.
TITLE = r"(?:the[ \t]+)?(?:mit|expat|x11|isc|zlib|0bsd|bsd|(?:zero|[0-9])[ -]clause[ -]bsd|(?:simplified|modified|new|revised|free)[ \t]+bsd)(?:[ \t]+no[ \t]+attribution|[ \t]+(?:zero|[0-9])[ -]clause)?(?:[ \t]+[\"']?(?:new|simplified|revised|modified)[\"']?(?:[ \t]+or[ \t]+[\"']?(?:new|simplified|revised|modified)[\"']?)?)?(?:[ \t]+licen[sc]e)?(?:[ \t]+\([^)\n]{1,40}\))?[.:]?"
HEAD = rf"\A(?:[\s#/*;=-]*(?:{TITLE}|copyright[ \t]+(?!notice|holder|owner|law|act\b)[^\n]{{1,200}})[ \t\r*#/=-]*(?=\n|\z)){{1,20}}"
#: The registered SQL keeps its rule and its table.
SQL_COPYRIGHT_LINE = r"(^|\n)[ \t#/*;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings that mean the same, and typographic marks.
SPELLINGS = [("licence", "license"), ("non-commercial", "noncommercial"), ("sub-license", "sublicense"), ("favour", "favor"), ("whilst", "while"), ("organisation", "organization"), ("http://", "https://"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-")]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
#: Texts of known licences and of usual notices.
KNOWN = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AUTHOR,
    "BSD-2-Clause": _BSD_TERMS + _BSD,
    "BSD-3-Clause": _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
}


def known_texts() -> dict[str, str]:
    """KNOWN and the full texts, by id."""
    return KNOWN | {f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, NOTICE_LINE, "$1")
    out = F.regexp_replace(out, HEAD, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id and digest; of licences with one canonical text, the first name."""
    rows = spark.createDataFrame(list((known_texts() if texts is None else texts).items()), "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """Adds canonical_sha256 and license_id, null where the whole text is no known licence."""
    texts = known_texts() if texts is None else texts
    size = len(texts)
    known = known_licenses(docs.sparkSession, texts).withColumnRenamed("digest", "canonical_sha256")
    rows = docs.withColumn("__digest", digest(F.col(text_col)))
    rows = unclashed(rows, ["canonical_sha256", "license_id"]).withColumnRenamed("__digest", "canonical_sha256")
    return rows.join(F.broadcast(known) if size <= MAX_BROADCAST else known, "canonical_sha256", "left")


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, {quote(SQL_COPYRIGHT_LINE)}, '\\1', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    out = f"sha256(trim(regexp_replace({out}, {quote(NOT_WORD)}, ' ', 'g'), ' '))"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in KNOWN.items())
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, {out} AS digest FROM (VALUES {values}) AS v(license_id, text)) GROUP BY digest),
scanned AS (SELECT doc_id, {out} AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM scanned LEFT JOIN known ON canonical_sha256 = digest
"""
