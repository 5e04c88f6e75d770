"""Licences as they are found in files: wrapped, on one line, titled, with notices, list marks, other case and spelling."""

import textwrap
from pathlib import Path

import duckdb
import pytest

from outlinelake.llm.licenses import DIGESTS, KNOWN, known_digests, scan_licenses
from outlinelake.llm.queries import oracle_sql

#: Texts that Debian ships, and the ids of those that are here.
SHIPPED = Path("/usr/share/common-licenses")
IDS = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def forms(name, text):
    """Of a known text, the forms that must be found."""
    notice = "Copyright (c) 2019-2024, Someone & Sons, Inc."
    for width in (47, 60, 79):
        yield f"{name} License\n\n{notice}\nAll rights reserved.\n\n" + "\n".join(textwrap.wrap(text, width))
    yield f"The {name} License {notice} {text}" if not name.startswith("Unl") else text
    yield "\n".join(f"# {x}" for x in ["Copyright Joyent, Inc. and other Node contributors.", "© 2020 A. Author", *textwrap.wrap(text.upper(), 70)])
    yield text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    yield text.replace("acknowledgment", "Acknowledgement").replace("COPYRIGHT HOLDER ", "COPYRIGHT OWNER ").replace("recognize", "recognise").replace('"', "''").replace("https:", "http:")


@pytest.fixture(scope="module")
def cases():
    out = [(name, x) for name, text in KNOWN.items() for x in forms(name, text)]
    for file, name in IDS.items():
        if (SHIPPED / file).exists():
            text = (SHIPPED / file).read_text()
            out += [(name, text), (name, " ".join(text.split())), (name, text.replace("\n", "\r\n").lower())]
            if "END OF TERMS" in text:
                out.append((name, text[: text.index("END OF TERMS")]))
    other = [KNOWN["MIT"] + " and more", KNOWN["MIT"].replace("free of charge", "for a fee"), "MIT License\n", "copyright", "", "Copyright (c) 2020 " + KNOWN["ISC"][40:], "1. a) " * 20]
    return [(i, *c) for i, c in enumerate(out + [(None, x) for x in other])]


def test_forms_in_spark_and_sql(spark, cases):
    docs = spark.createDataFrame([(i, t) for i, _, t in cases] + [(len(cases), None)], "doc_id long, text string")
    got = sorted(map(tuple, scan_licenses(docs, known_digests(spark)).collect()))
    assert [(i, name) for i, _, name in got] == [(i, name) for i, name, _ in cases] + [(len(cases), None)]
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, _, t in cases] + [(len(cases), None)])
    assert sorted(db.sql(oracle_sql()["op7_licenses"]).fetchall()) == got


def test_the_table_covers_the_usual_licences():
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"):
        assert DIGESTS[name]
    assert {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense"} <= set(KNOWN)
