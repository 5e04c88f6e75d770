"""The queries that SQL can express against that SQL, on whole tables."""

from pathlib import Path

import duckdb
import pytest

from outlinelake.llm.queries import oracle_sql, queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = db.sql(oracle_sql()[name])
    got = queries()[name](spark, str(SF)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_license_sql_knows_the_texts(spark):
    """Known texts among others, spelled otherwise and with a copyright line, in SQL and Spark alike."""
    from outlinelake.llm.licenses import KNOWN, known_digests, scan_licenses

    texts = [None, "", "Copyright (c) 2020 A. Author\n" + KNOWN["ISC"].upper(), KNOWN["Zlib"].replace("acknowledgment", "Acknowledgement"), KNOWN["MIT"] + " more", "whilst the licence; centre"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = sorted(db.sql(oracle_sql()["op7_licenses"]).fetchall())
    assert sorted(map(tuple, scan_licenses(docs, known_digests(spark)).collect())) == want
    assert [r[2] for r in want] == [None, None, "ISC", "Zlib", None, None]
