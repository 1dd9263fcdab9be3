"""Licence scan: entire texts, made canonical, joined by digest to known licences.

The canonical form drops copyright notices, lower-cases, writes equivalent spellings
in one way, and keeps words only. A text is a licence if its form's digest is that
of a known one: the short texts and notices of KNOWN with their usual titles, and the
entire texts in known_licenses, each also without what follows its terms.

A line is a copyright notice only where a year, (c), a placeholder or a name follows
the word, so that lines of a licence that is wrapped there stay. The SQL has KNOWN
alone and drops every line that begins with the word: it differs where a text is one
of the other licences or has such a line. All of it is DataFrame expressions; the known licences are a small
table (a digest and a name for each), so the join moves no text.

Defined results: null, empty and word-less texts have no licence and the digest of
the empty form; repeated rows are repeated; an empty table gives an empty table;
if two known licences have one form, the name that sorts first is given; other
columns are not read.
"""

from __future__ import annotations

from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What follows "copyright" at the start of a line of licence text; any other capitalised word there is a name.
NO_NAMES = "and|are|as|by|disclaimers?|doctrines?|for|holders?|if|in|infringement|interests?|interfaces?|is|laws?|licen[cs]es?|materials?|notices?|of|on|or|owners?|ownership|permissions?|protection|resulting|statements?|that|this|to|treat(?:y|ies)|which|with|you|your"
#: Fixed value: the lines that are dropped, in a text's own case.
NOTICES = (
    r"(?m)^[^\n\p{L}\p{N}(©]*(?:©|(?i:all rights reserved)|\([cC]\)[ \t]*(?:(?i:copyright)|©|[0-9]{4}|[<\[{])"
    r"|(?i:copyright)[ \t]*[:,]?[ \t]*(?:\([cC]\)|©|[0-9]{4}|[<\[{])"
    rf"|(?i:copyright)[ \t]*[:,]?[ \t]+(?i:by[ \t]+)?(?!(?i:{NO_NAMES})\b)\p{{Lu}})[^\n]*$"
)
#: Fixed values of the SQL: lines that are dropped, and spellings that count as one (regular expressions that Java and RE2 read alike).
COPYRIGHT_LINES = r"(?m)^[^\n\p{L}\p{N}(©]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
SPELLINGS = (
    (r"licence", "license"),
    (r"sub-licens", "sublicens"),
    (r"non-infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"per cent\b", "percent"),
    (r"organis", "organiz"),
    (r"favour", "favor"),
    (r"behaviour", "behavior"),
    (r"acknowledgement", "acknowledgment"),
    (r"whilst", "while"),
    (r"https://", "http://"),
    (r"&", " and "),
)
WORDS_ONLY = r"[^\p{L}\p{N}]+"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ISC = ZERO_BSD.replace("is hereby granted.", "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Names and texts (or notices that stand for a text) of public licences.
KNOWN = (
    ("MIT", MIT),
    ("MIT", "The MIT License\n\n" + MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("0BSD", ZERO_BSD),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("Zlib", ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
)
#: The usual titles of the short texts, and notices besides those of KNOWN.
TITLED = (
    ("MIT", MIT, ("The MIT License (MIT)", "MIT License (MIT)")),
    ("0BSD", ZERO_BSD, ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD License")),
    ("ISC", ISC, ("The ISC License", "ISC License (ISC)")),
    ("BSD-2-Clause", BSD_2, ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "The BSD 2-Clause License")),
    ("BSD-3-Clause", BSD_3, ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "The BSD 3-Clause License")),
    ("Zlib", ZLIB, ("zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng license")),
)
MORE_NOTICES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


@cache
def known_licenses() -> tuple[tuple[str, str], ...]:
    """(name, text) of every known licence, title and notice."""
    found = [*KNOWN, *MORE_NOTICES]
    found += [(name, f"{title}\n\n{text}") for name, text, titles in TITLED for title in titles]
    for file in resources.files(__package__).joinpath("known_licenses").iterdir():
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        terms, end, _ = text.partition(END_OF_TERMS)
        found += [(name, text)] + ([(name, terms), (name, terms + end)] if end else [])
    return tuple(found)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    form = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NOTICES, ""))
    for spelling, one in SPELLINGS:
        form = F.regexp_replace(form, spelling, one)
    return F.btrim(F.regexp_replace(form, WORDS_ONLY, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(like: DataFrame, known=None) -> DataFrame:
    """(digest, license_id): one row per known form (of known_licenses() if none are given), made by the same expression as the documents'."""
    rows = like.sparkSession.createDataFrame([(n, t) for n, t in known or known_licenses()], "license_id string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=None) -> DataFrame:
    """(id, digest, license_id) of every whole text; license_id is null if it is no known licence."""
    rows = docs.select(F.col(id_col), digest(F.col(text_col)).alias("digest"))
    # the driver made the table of known licences from its own list, so it is small enough to send
    return rows.join(F.broadcast(known_digests(docs, known)), "digest", "left").select(id_col, "digest", "license_id")


def canonical_sql(text: str) -> str:
    """The canonical form in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(lower(coalesce({text}, '')), {quote(COPYRIGHT_LINES)}, '', 'g')"
    for spelling, one in SPELLINGS:
        form = f"regexp_replace({form}, {quote(spelling)}, {quote(one)}, 'g')"
    return f"trim(regexp_replace({form}, {quote(WORDS_ONLY)}, ' ', 'g'))"


def scan_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    known = f"SELECT sha256({canonical_sql('text')}) AS digest, min(license_id) AS license_id FROM (VALUES {values}) AS v(license_id, text) GROUP BY 1"
    return f"WITH known AS ({known}), docs AS (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents) SELECT docs.doc_id, docs.digest, known.license_id FROM docs LEFT JOIN known USING (digest)"
