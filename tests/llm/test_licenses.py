import hashlib
import re
import textwrap

import duckdb
import pytest

from lodestone.llm import licenses
from lodestone.llm.common import table


def form(text):
    """The canonical form by another engine's regular expressions."""
    text = re.sub(r"(?m)^[^\n\w(©]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$", "", (text or "").lower())
    for a, b in licenses.SPELLINGS:
        text = re.sub(a, b, text)
    return re.sub(r"[\W_]+", " ", text).strip()


CASES = [
    (1, licenses.MIT, "MIT"),
    (2, "MIT Licence\n\nCopyright (c) 2019-2021 Some One <a@b.example>\n\n" + licenses.MIT.upper(), "MIT"),
    (3, "  (C) 2001 X\n# Copyright © Y\n" + licenses.MIT.replace('"', "''").replace("\n", "\r\n  "), "MIT"),
    (4, licenses.MIT.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("sublicense", "sub-license"), "MIT"),
    (5, licenses.MIT + " And more.", None),
    (6, licenses.BSD_2, "BSD-2-Clause"),
    (7, "Copyright 1999 Z. All rights reserved.\n" + licenses.BSD_3, "BSD-3-Clause"),
    (8, licenses.ISC, "ISC"),
    (9, licenses.ZERO_BSD.replace("and/or", "and / or"), "0BSD"),
    (10, licenses.ZLIB.replace("acknowledgment", "acknowledgement"), "Zlib"),
    (11, None, None),
    (12, "", None),
    (13, " ... ", None),
    (14, "prose about the MIT license", None),
    (None, licenses.MIT, "MIT"),
    (15, licenses.MIT * 200, None),
    (16, "Größe übt", None),
    (1, licenses.MIT, "MIT"),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in CASES], "doc_id long, text string, license_id string")
    got = sorted(map(str, map(tuple, licenses.scan(docs).collect())))
    assert got == sorted(str((i, hashlib.sha256(form(t).encode()).hexdigest(), n)) for i, t, n in CASES)
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Pandas", plan)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(map(str, con.sql(licenses.scan_sql()).fetchall()))
    assert sorted(str(tuple(r)) for r in licenses.scan(table(spark, sf, "documents")).collect()) == want


def wrapped(text, width):
    """The text in lines of another length; paragraphs that have a notice stay."""
    wrap = lambda p: p if re.search(r"(?i)copyright *(\(c\)|©|\[)", p) else textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False, break_long_words=False)
    return "\n\n".join(wrap(p) for p in re.split(r"\n\s*\n", text))


def test_whole_licences_in_any_wrapping(spark):
    known = licenses.known_licenses()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"} <= {n for n, t in known if len(t) > 1_000}
    rows = [(k, n, t) for k, (n, t) in enumerate((n, w) for n, t in known for w in (t, wrapped(t, 40), wrapped(t, 77), "Copyright 2019 Some One\n\n" + t))]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")).collect()}
    assert [(n, t[:60]) for k, n, t in rows if got[k] != n] == []


def test_only_notices_are_dropped(spark):
    isc = licenses.ISC.replace("that the above copyright", "that the above\ncopyright")
    texts = [
        ("ISC", isc),
        (None, isc.replace("\ncopyright notice and this permission notice appear in all copies.", "\ncopyright notice goes away.")),
        ("ISC", isc.upper()),
        ("ISC", "Copyright Some One\nCopyright by X Y\nCopyright (c) some one\n(c) 2020 z\n\n" + isc),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
        (None, "Licensed under CC BY-NC 4.0.\n(c) You must retain this."),
        ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2019, Z\nAll rights reserved.\n\n" + licenses.BSD_2),
    ]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    assert [got[k] for k in range(len(texts))] == [n for n, _ in texts]
